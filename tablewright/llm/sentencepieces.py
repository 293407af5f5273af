"""SentencePiece encoding by streaming Viterbi, and decoding.

The pieces and scores come from a public model file; nothing is trained. A text's
segmentation is the one with the highest sum of scores. The search runs over the text
once, in windows bounded by the longest piece. It keeps the best score of the positions
that pieces begun so far can reach, at most the longest piece ahead, and the paths that
lead to them as a tree. When all of them go back to one boundary, the ids up to there are
final: they are committed and forgotten. Scores start at zero again where a single
position is left, so long texts lose no precision.

A boundary that no piece of the vocabulary can cross is such a meeting point whatever
stands around it. In the usual vocabularies that holds before a white space mark and
around characters that are in no piece (a line break); the segments between them are
independent, and each Python worker keeps the ids of segments it has met, in two
generations of CACHED_BYTES together. A vocabulary without that property is searched as a whole.

Rules: a mark is put before the text; blanks are marks; a character that is no piece by
itself can stand alone at a cost of ten more than the worst score and is written as its
UTF-8 bytes; among equal scores the later start of the last piece wins, which makes
paths meet sooner. Decoding joins the pieces, turns marks into blanks and drops the first.

Defined cases: null and empty texts have no ids and decode to an empty text; a text
that holds the mark itself (U+2581) decodes to one with blanks; very long texts take time
in proportion, also a run of one character, whose paths may never meet before its end;
repeated rows are encoded each; an empty table gives an empty result; other columns, of
any name, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import PART_BYTES, in_parts, released, split_at_blanks, strung, text_sizes

MARK = "▁"
END = 0
UNKNOWN_PENALTY = 10.0
#: Bytes of kept segments in both generations, with what an entry costs beside its texts.
CACHED_BYTES, ENTRY_BYTES = 140 << 20, 200
#: Longer segments are not kept.
LONGEST_KEPT = 200
#: Characters that the search is fed at a time.
FED = 4096


class Pieces:
    """The tables of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.scores: dict[str, tuple[float, int]] = {}
        # nested by character; a piece ends where END is a key
        self.trie: dict = {}
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids: dict[int, int] = {}
        worst, normal = 0.0, []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(piece)
                worst = min(worst, model.get_score(i))
                self.bytes_of[i] = piece.replace(MARK, " ").encode("utf-8")
                self.scores[piece] = (model.get_score(i), i)
                node = self.trie
                for char in piece:
                    node = node.setdefault(char, {})
                node[END] = self.scores[piece]
        self.spelled = pa.array(self.bytes_of, pa.large_binary())
        self.longest = max(map(len, normal))
        self.unknown = worst - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        crossing = any(MARK in p.lstrip(MARK) or "\n" in p for p in normal)
        self.segment = None if crossing else re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")

    def fallback(self, char: str) -> list[int]:
        if len(self.byte_ids) < 256:
            return [self.unknown_id]
        return [self.byte_ids[b] for b in char.encode("utf-8")]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text

    def decode_all(self, flat: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the ids that stand in ``flat`` between the places ``at``."""
        pieces = self.spelled.take(pa.array(flat))
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset + at].tolist()
        data = pieces.buffers()[2]
        whole = memoryview(data) if data is not None else memoryview(b"")
        texts = [str(whole[a:b], "utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


class Boundary:
    """A live boundary, or one that live ones go back to: the ids since its parent, and its children."""

    __slots__ = ("parent", "ids", "kids")

    def __init__(self, parent: Boundary | None, ids: list[int]):
        self.parent, self.ids, self.kids = parent, ids, set()


class Viterbi:
    """Streaming search: ``feed`` takes text as it comes and returns ids that are final.

    The search goes over the text in windows of as many starts as the longest piece has
    characters. What a window hands on are the boundaries behind it that pieces begun so far
    reach, as many at most, each with its score and the ids of its best path through the
    window. These boundaries form a tree: one that no later boundary goes back to is cut
    off, and while the root has a single child, all surviving paths go through it, so its
    ids are committed and it becomes the root. Every boundary is made and cut once, and of
    the text only the window and the longest piece behind it are held.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""
        self.root = Boundary(None, [])
        # offset in the text, score, boundary
        self.live: list[tuple[int, float, Boundary]] = [(0, 0.0, self.root)]

    def feed(self, text: str, last: bool = False) -> list[int]:
        """Ids that became final. A window is searched once the longest piece fits behind it, or at the end."""
        if last and not self.text and len(text) <= self.pieces.longest and len(self.live) == 1 and not self.live[0][0]:
            return self._short(text)
        self.text += text
        width, out, at = self.pieces.longest, [], 0
        while len(self.text) - at >= 2 * width or last and at < len(self.text):
            window = self.text[at : at + 2 * width]
            out += self._window(window, min(width, len(window)))
            at += width
        self.text = self.text[at:]
        return out

    def finish(self) -> list[int]:
        return self.feed("", last=True)

    def _short(self, text: str) -> list[int]:
        """The rest of a text that is no longer than a window: its search hands nothing on."""
        trie, unknown, n = self.pieces.trie, self.pieces.unknown, len(text)
        best: list[float | None] = [None] * (n + 1)
        back: list = [None] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            here = best[s]
            if here is None:
                continue
            node, e = trie, s
            for char in text[s:]:
                node = node.get(char)
                if node is None:
                    break
                e += 1
                found = node.get(END)
                if found is not None:
                    score, other = here + found[0], best[e]
                    if other is None or score >= other:
                        best[e], back[e] = score, (s, found[1])
            if (best[s + 1] is None or here + unknown > best[s + 1]) and END not in trie.get(text[s], ()):
                best[s + 1], back[s + 1] = here + unknown, (s, -1)
        ids, e = [], n
        while e:
            start, piece = back[e]
            ids += [piece] if piece >= 0 else self.pieces.fallback(text[start])[::-1]
            e = start
        return ids[::-1]

    def _window(self, text: str, width: int) -> list[int]:
        """Search from the first ``width`` starts of ``text``."""
        trie, unknown, n = self.pieces.trie, self.pieces.unknown, len(text)
        best: list[float | None] = [None] * (n + 1)
        # the start and the piece that lead to a boundary; those handed on have themselves
        back: list = [None] * (n + 1)
        for at, score, boundary in self.live:
            best[at], back[at] = score, (-1, boundary)
        for s in range(width):
            here = best[s]
            if here is None:
                continue
            single, node, e = False, trie, s
            while e < n:
                node = node.get(text[e])
                if node is None:
                    break
                e += 1
                found = node.get(END)
                if found is not None:
                    single = single or e == s + 1
                    score, other = here + found[0], best[e]
                    if other is None or score >= other:
                        best[e], back[e] = score, (s, found[1])
            if not single and (best[s + 1] is None or here + unknown > best[s + 1]):
                best[s + 1], back[s + 1] = here + unknown, (s, -1)
        before, self.live = self.live, []
        for e in range(width, n + 1):
            if best[e] is not None:
                ids, at = [], e
                start, piece = back[at]
                while start >= 0:
                    ids += [piece] if piece >= 0 else self.pieces.fallback(text[start])[::-1]
                    at = start
                    start, piece = back[at]
                boundary = Boundary(piece, ids[::-1])
                piece.kids.add(boundary)
                self.live.append((e - width, best[e], boundary))
        for _, _, boundary in before:
            self._cut(boundary)
        return self._committed()

    def _cut(self, boundary: Boundary) -> None:
        """Take off a boundary that nothing goes back to, and what only led to it."""
        while not boundary.kids and boundary.parent is not None:
            parent, boundary.parent = boundary.parent, None
            parent.kids.discard(boundary)
            boundary = parent

    def _committed(self) -> list[int]:
        out: list[int] = []
        while len(self.root.kids) == 1:
            (self.root,) = self.root.kids
            self.root.parent = None
            out += self.root.ids
            self.root.ids = []
        if len(self.live) == 1:
            # scores start at zero again
            self.live = [(self.live[0][0], 0.0, self.live[0][2])]
        return out


class Encoder:
    """Texts to ids: the stream of a text's segments, each searched once as long as it is kept.

    A segment lies between boundaries that no piece crosses, where all paths meet and the
    search has committed everything; so its ids can be kept and used again there.
    """

    def __init__(self, pieces: Pieces, size: int = CACHED_BYTES):
        self.pieces, self.size, self.bytes = pieces, size, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def search(self, text: str) -> list[int]:
        run, out = Viterbi(self.pieces), []
        if len(text) <= FED:
            return run.feed(text, last=True)
        for i in range(0, len(text), FED):
            out += run.feed(text[i : i + FED])
        return out + run.finish()

    def _segment(self, segment: str) -> bytes:
        return np.array(self.search(segment), np.uint32).tobytes()

    def _known(self, unit: str) -> bytes:
        """Ids of what stands between two blanks, which is a segment unless it holds line breaks."""
        ids = self.old.get(unit)
        if ids is None:
            segments = self.pieces.segment.findall(MARK + unit)
            if len(segments) > 1:
                # its segments are kept instead, the first as the unit that it would be alone
                first = segments[0].removeprefix(MARK)
                return b"".join([self.young.get(first) or self._known(first), *map(self._inner, segments[1:])])
            ids = self._segment(segments[0])
        self._keep(unit, ids)
        return ids

    def _inner(self, segment: str) -> bytes:
        """Ids of a segment that does not follow a blank. It is kept after one, since no unit holds a blank."""
        key = " " + segment
        ids = self.young.get(key)
        if ids is None:
            ids = self.old.get(key) or self._segment(segment)
            self._keep(key, ids)
        return ids

    def _keep(self, key: str, ids: bytes) -> None:
        if len(key) > LONGEST_KEPT:
            return
        if self.bytes >= self.size // 2:
            self.young, self.old, self.bytes = {}, self.young, 0
        self.young[key] = ids
        self.bytes += ENTRY_BYTES + len(key) + len(ids)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin and end."""
        if self.pieces.segment is None:
            found = [np.array(self.search(MARK + t.replace(" ", MARK)) if t else [], np.uint32) for t in texts]
            at = np.cumsum([0, *map(len, found)])
            return np.concatenate([np.empty(0, np.uint32), *found]), at
        ends, numbers, units = split_at_blanks([_units(t) for t in texts if t])
        # a unit is looked up once, however often it stands in the texts
        own = list(map(self.young.get, units))
        own = [self._known(u) if ids is None else ids for u, ids in zip(units, own, strict=True)]
        flat, at = strung(own, numbers, ends, np.uint32)
        # a null or empty text has no ids
        return flat, at[np.cumsum([0, *(bool(t) for t in texts)])]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


_AFTER_BLANK = re.compile("(?<= ) ")


def _units(text: str) -> str:
    """``text`` such that each blank is the first mark of a run and starts a unit; further marks belong to the unit."""
    if MARK in text:
        text = text.replace(MARK, " ")
    return _AFTER_BLANK.sub(MARK, " " + text)[1:] if "  " in text or text.startswith(" ") else text


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept: int = CACHED_BYTES) -> Encoder:
    """The worker's encoder for one model file, which keeps ``kept`` bytes of segments."""
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = Encoder(Pieces(path), kept)
    return _ENCODERS[path, kept]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode_batches(path: str, kept: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, most = encoder(path, kept), min(PART_BYTES, kept // 16)
    for batch in batches:
        for part in in_parts(batch, text_sizes(batch.column("text")), most):
            flat, at = own.encode_all(part.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])


def encoded(docs: DataFrame, path: str | None = None, kept: int = CACHED_BYTES) -> DataFrame:
    """(doc_id, ids) of every row. ``kept``: bytes of segments that a worker keeps; fewer take more time."""
    path = path or model_path()
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(released(partial(_encode_batches, path, kept)), "doc_id long, ids array<int>")


def _decode_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = encoder(path).pieces
    for batch in batches:
        counts = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
        for part in in_parts(batch, counts.astype(np.int64) * 4):
            lists = part.column("ids")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            # flatten leaves out what stands under a null
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                    pa.array(pieces.decode_all(flat, at), pa.string()),
                ],
                names=["doc_id", "n_ids", "ids_crc32", "text"],
            )


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text) of rows with doc_id and ids."""
    path = path or model_path()
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )
    return ids.select("doc_id", "ids").mapInArrow(released(partial(_decode_batches, path)), schema)
