"""Exact encoding and decoding with a SentencePiece model of merge type (BPE).

A text is exactly encoded by a sequence of pieces if every two neighbours are compatible: merging their joined
characters anew, best piece first, gives just these two again. So a sequence is searched from the left: at each position
the longest piece that matches (found by an Aho-Corasick automaton over the vocabulary) and is compatible with its
predecessor is taken; where none is left, the position is marked in a bitfield of failed positions and the search steps
back to the next shorter piece. Characters that no piece holds become byte pieces.

Texts are cut beforehand only between characters that no piece holds side by side, where no merge can reach across; of
the chunks of many texts each distinct one is searched once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aulario.llm.chunks import Ids, Remembered, runs, windows
from aulario.llm.texts import slices, text_bytes, tidy

SPACE = "▁"

#: Chunks whose ids a Python process remembers, and of parts of chunks and of pairs twice as many as KEPT_PARTS at most,
#: the parts of at most so many characters. It saves work only.
KEPT_CHUNKS = 400_000
KEPT_PARTS = 50_000
KEPT_LENGTH = 48
#: Text that is encoded at once, in bytes; a longer text in parts.
AT_ONCE = 2 << 20
PAIR = 1 << 24
NEVER = float("inf")


class Memory(dict):
    """A dict of bounded size: when full it becomes the older half, from which what is asked for again moves over.

    Texts beyond KEPT_LENGTH are made anew each time.
    """

    def __init__(self, make, most: int = KEPT_PARTS):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if type(key) is str and len(key) > KEPT_LENGTH:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class MergeCodec:
    """Encoder and decoder over the vocabulary of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = own.get_piece_size()
        self.pieces = [own.id_to_piece(i) for i in range(n)]
        self.end_id, self.unknown = own.eos_id(), own.unk_id()
        plain = [i for i in range(n) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: own.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if own.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(n) if own.is_control(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.beside = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        self.edges: dict[str, tuple[list, list]] = {}
        self.compatible = Memory(self.fits)
        self.distinct = Remembered(self.chunk_ids, KEPT_CHUNKS)
        self.inner = Memory(self.bounded)
        # a chunk is some spaces and what follows up to the next space, if no piece goes on with a space
        self.spaced = any(pair[1] == SPACE != pair[0] for pair in self.beside)
        self.feed = not any("\n" in pair for pair in self.beside)

    def merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """The parts of a short text after each merge, with its cost: best-scored pair first, leftmost of equals."""
        parts = list(text)
        yield -NEVER, parts
        while len(parts) > 1:
            scores = [self.score.get(a + b, -NEVER) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -NEVER:
                break
            at = scores.index(best)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            yield -best, parts

    def merged(self, text: str) -> list[str]:
        *_, (_, parts) = self.merges(text)
        return parts

    def edge(self, piece: str) -> tuple[list, list]:
        """What stands at the left and at the right edge while the piece is merged: (part, made at, used up at)."""
        known = self.edges.get(piece)
        if known is None:
            known = [], []
            for cost, parts in self.merges(piece):
                for side, part in ((known[0], parts[0]), (known[1], parts[-1])):
                    if not side or side[-1][0] != part:
                        if side:
                            side[-1] = (*side[-1][:2], cost)
                        side.append((part, cost, NEVER))
            self.edges[piece] = known
        return known

    def fits(self, pair: int) -> bool:
        """Whether merging two pieces' characters anew gives them again; the pair is left id * PAIR + right id.

        Both merge by themselves until something merges across their bound: parts of the left piece's right edge and
        of the right piece's left edge that stand at the time their own merge is due. Of equal merges the left one
        comes first, so an edge part of the left piece is used up before an equal merge across the bound.
        """
        score, first, second = self.score, self.pieces[pair // PAIR], self.pieces[pair % PAIR]
        for left, made, used in self.edge(first)[1]:
            for right, made_too, used_too in self.edge(second)[0]:
                due = score.get(left + right)
                if due is not None and made < -due < used and made_too < -due <= used_too:
                    return False
        return True

    def bounded(self, text: str) -> bytes:
        """Ids (32 bits each) of a text without inner bounds, by longest matches and steps back."""
        ids, compatible = self.ids, self.compatible
        # the search's first way: the longest match at every position, all of them compatible
        found, covered = [], 0
        for end, length in self.automaton.iter_long(text):
            found.append(ids[text[end - length + 1 : end + 1]])
            covered += length
        if covered == len(text):
            for a, b in zip(found, found[1:]):
                if not compatible[a * PAIR + b]:
                    break
            else:
                return array("i", found).tobytes()
        return array("i", self.searched(text)).tobytes()

    def searched(self, text: str) -> list[int]:
        ids, compatible = self.ids, self.compatible
        # matches of one start come with ascending ends, so the longest stays; other characters stand alone
        longest = {end - length + 1: length for end, length in self.automaton.iter(text)}
        n = len(text)
        failed = bytearray(n // 8 + 1)
        # bounds and id of the pieces so far; a character beyond the vocabulary has no id, and nothing merges with it
        chosen: list[tuple[int, int, int | None]] = []
        at, end, last = 0, longest.get(0, 1), None
        while at < n:
            while end > at:
                number = ids.get(text[at:end])
                if (number is not None or end == at + 1) and not failed[end >> 3] >> (end & 7) & 1:
                    if last is None or number is None or compatible[last * PAIR + number]:
                        break
                end -= 1  # the next shorter piece
            if end > at:
                chosen.append((at, end, number))
                last, at = number, end
                end = at + longest.get(at, 1)
                continue
            if not chosen:
                raise ValueError("the vocabulary's merges do not reach this text")
            failed[at >> 3] |= 1 << (at & 7)
            at, end, _ = chosen.pop()
            last = chosen[-1][2] if chosen else None
            end -= 1
        found: list[int] = []
        for at, end, number in chosen:
            if number is not None:
                found.append(number)
            else:
                found.extend(self.byte_ids[b] for b in text[at:end].encode())
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk; marks at its end are cut off where no piece holds them beside what precedes."""
        end = len(text)
        for at in range(end - 1, max(0, end - 3), -1):
            if text[at - 1 : at + 1] not in self.beside:
                return self.inner[text[:at]] + self.inner[text[at:]]
        return self.inner[text]

    def cuts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Whether a chunk begins at each byte: at a space that follows none, and before and after a line feed."""
        begins = np.zeros(len(data), dtype=bool)
        if len(data) > 1 and not self.spaced:
            here, after = data[:-1], data[1:]
            # 0x81 is the last byte of the mark that stands for a space, and of other characters
            begins[1:] = (after == 0x20) & (here != 0x20) & (here != 0x81)
            if self.feed:
                begins[1:] |= (after == 0x0A) | (here == 0x0A)
        begins[edges] = True
        return begins

    def chunk_ids(self, texts: pa.Array) -> Ids:
        found = [self.chunk(text.replace(" ", SPACE)) for text in texts.to_pylist()]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        return np.frombuffer(b"".join(found), dtype=np.uint32), np.cumsum(sizes) - sizes, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id last, and the n + 1 bounds between texts."""
        data, at = text_bytes(column)
        # a text that is not empty begins with a space
        sizes = np.diff(at)
        data = np.insert(data, at[:-1][sizes > 0], 0x20)
        at = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
        found, starts, counts = [], [], []
        for begins, chunks in windows(data, at, self.cuts, AT_ONCE):
            ids, first, count = self.distinct(chunks.dictionary)
            order = chunks.indices.to_numpy()
            found.append(ids[runs(first[order], count[order])])
            starts.append(begins)
            counts.append(count[order])
        if not found:
            bounds = np.zeros(len(at), dtype=np.int64)
            whole = np.zeros(0, dtype=np.int32)
        else:
            before = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            bounds = before[np.searchsorted(np.concatenate(starts), at)]
            whole = np.concatenate(found).astype(np.int32)
        return np.insert(whole, bounds[1:], self.end_id), bounds + np.arange(len(bounds))

    def surfaces(self) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all pieces one after the other (nothing for silent ones), and their n + 1 bounds."""
        whole = []
        for i, piece in enumerate(self.pieces):
            if i in self.bytes_of:
                whole.append(bytes([self.bytes_of[i]]))
            elif i in self.silent:
                whole.append(b"")
            elif i == self.unknown:
                whole.append(" ⁇ ".encode())
            else:
                whole.append(piece.replace(SPACE, " ").encode())
        return np.frombuffer(b"".join(whole), dtype=np.uint8), np.cumsum([0, *map(len, whole)])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids; the space before the first word is left out, bytes that are no UTF-8 are replaced."""
        if not hasattr(self, "_surfaces"):
            self._surfaces = self.surfaces()
            self._spaced = np.array([p.startswith(SPACE) for p in self.pieces])
            self._silent = np.zeros(len(self.pieces), dtype=bool)
            self._silent[list(self.silent)] = True
        data, at = self._surfaces
        said = ~self._silent[ids]
        bounds = np.concatenate([[0], np.cumsum(said)])[bounds]
        ids = ids[said]
        sizes = at[ids + 1] - at[ids]
        whole = data[runs(at[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        texts = [whole[s:e].decode("utf-8", errors="replace") for s, e in zip(ends, ends[1:])]
        first = ids[np.minimum(bounds[:-1], max(0, len(ids) - 1))] if len(ids) else np.zeros(len(texts), dtype=np.int32)
        return [t[1:] if t and s else t for t, s in zip(texts, self._spaced[first].tolist())]


_codecs: dict[int, MergeCodec] = {}


def codec(model: bytes) -> MergeCodec:
    """One codec per Python process and model."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = MergeCodec(model)
    return _codecs[key]


def model_bytes(path: str) -> bytes:
    """The model file's content, read by the driver and sent along with the tasks (a vocabulary, well below 10 MB)."""
    with open(path, "rb") as file:
        return file.read()


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of every row of `docs` (doc_id, text; other columns are not read).

    Ids end with the end id and begin without a start id; there is no sampling. `decoded` is what the ids decode to:
    the text itself, but for U+2581, which decodes to a space. A null text counts as empty and has the end id
    only. Rows are handled one by one: repeated rows get equal rows, an empty table gives an empty table.
    """
    model = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                ids, bounds = own.encode(part.column(1))
                decoded = pa.array(own.decode(ids, bounds), pa.string())
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, decoded],
                    ["doc_id", "ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, decoded string")
