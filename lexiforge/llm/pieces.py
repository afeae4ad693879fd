"""SentencePiece BPE encoding with a merge-type prefix table, and decoding.

For each prefix of a text, byte-pair merging leaves exactly one last piece.
The table is filled left to right: an automaton lists the pieces that end at a
position, longest first, and the first one whose pair with the last piece of
the prefix before it survives merging is the answer.  The ids are recovered
backwards from the end.  No piece of the model spans a gap between a word and
the next word mark, so the table is kept per pre-token and reused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, columns_of, pieces

MARK = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_MIXED = re.compile(f"[{_LATIN}][^{_LATIN}]|[^{_LATIN}{MARK}][{_LATIN}]")
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_WORDS_APART = re.compile(f"{MARK}*[{_LATIN}]+|{MARK}*[^{MARK}\n{_LATIN}]+|{MARK}+|\n")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Generations(dict):
    """A memo of bounded size: when the young generation is full it becomes the old one."""

    def __init__(self, make, limit: int = 250_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


#: An idle model remembers up to so many pre-tokens.
IDLE = 50_000


class PieceModel:
    """Pieces, merge priorities and byte ids read from a sentencepiece model file's bytes."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.text: dict[int, str] = {}
        self.bytes: dict[int, int] = {}
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[i] = int(piece[3:-1], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.text[i], self.rank[piece] = i, piece, sp.get_score(i)
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        if any(c not in self.ids for p in self.ids for c in p) or any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in self.ids):
            raise ValueError("the model has pieces over unknown characters, or across word marks or line ends")
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}
        for piece, i in self.ids.items():
            if self.merge(piece, self.halves) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.ends = {self.ids[p]: self._spine(p, 1) for p in self.ids if len(p) == 1 or p in self.halves}
        self.starts = {self.ids[p]: self._spine(p, 0) for p in self.ids if len(p) == 1 or p in self.halves}
        self.automaton.make_automaton()
        # where no piece joins Latin letters to other characters, they are pre-tokens apart
        self.parts = (_WORDS if any(_MIXED.search(p) for p in self.ids) else _WORDS_APART).findall
        self.pairs: dict[int, bool] = {}
        self.text_of = {str(i): p for i, p in self.text.items()}
        self.encoded = Generations(self._encode_part)
        self.decoded = Generations(self._decode_part)
        probe = " Ａ ﬁ é  x\n12 \t"
        if ",".join(self.encode(probe)) != ",".join(map(str, sp.encode(probe))):
            raise ValueError("the model's type or its settings of normalisation are not the ones implemented: merges by score, text as it is, one blank in front")

    def merge(self, text: str, halves: dict | None = None) -> list[str]:
        """Plain byte-pair merging of a short string, best score first and leftmost on ties.

        ``halves``, if given, gets the two parts of the last merge when one piece is left.
        """
        parts, pair = list(text), None
        while len(parts) > 1:
            found = [(self.rank[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not found:
                break
            k = -max(found)[1]
            pair = (parts[k], parts[k + 1])
            parts[k : k + 2] = ["".join(pair)]
        if halves is not None and pair and len(parts) == 1:
            halves[text] = pair
        return parts

    def _spine(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """The piece, its half on one side, that one's half, ...: (text, when formed, when merged away)."""
        out, gone = [], float("inf")
        while True:
            formed = -self.rank[piece] if len(piece) > 1 else float("-inf")
            out.append((piece, formed, gone))
            if len(piece) == 1:
                return out
            piece, gone = self.halves[piece][side], formed

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces side by side.

        The merges of both are undone, latest first; at no time may the parts
        that touch at the seam form a piece that would have been merged sooner.
        """
        a, b, i, j = self.ends[left], self.starts[right], 0, 0
        while True:
            (x, formed_x, gone_x), (y, formed_y, gone_y) = a[i], b[j]
            score = self.rank.get(x + y)
            if score is not None and -score < gone_x and -score <= gone_y:
                ok = False
                break
            if formed_x > formed_y:
                i += 1
            elif len(y) > 1:
                j += 1
            else:
                ok = True
                break
        if len(self.pairs) > 1_500_000:
            self.pairs.clear()
        self.pairs[left << 20 | right] = ok
        return ok

    def prefix_table(self, word: str) -> tuple[list[int], list[int]]:
        """For each prefix of ``word`` the id and length of its last piece; -1 for a character without a piece."""
        last, length, known = [-1] * len(word), [1] * len(word), self.pairs.get
        done = -1
        for end, (piece, n) in self.automaton.iter(word):  # longest first at each end
            if end != done:
                if n <= end and (left := last[end - n]) >= 0:
                    ok = known(left << 20 | piece)
                    if ok is None:
                        ok = self.compatible(left, piece)
                    if not ok:
                        continue
                last[end], length[end], done = piece, n, end
        return last, length

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, recovered backwards from its prefix table."""
        last, length = self.prefix_table(word)
        out, at = [], len(word) - 1
        while at >= 0:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.byte_ids[b] for b in reversed(word[at].encode("utf-8", "replace")))
            at -= length[at]
        return out[::-1]

    def _encode_part(self, word: str) -> str:
        return ",".join(map(str, self.encode_word(word)))

    def _decode_part(self, ids: str) -> str:
        try:
            return "".join(map(self.text_of.__getitem__, ids.split(",")))
        except KeyError:  # it has byte pieces
            pass
        out, raw = [], bytearray()
        for i in map(int, ids.split(",")):
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str | None) -> list[str]:
        """Ids of a whole text as decimal strings joined by commas, one for each pre-token."""
        if not text:
            return []
        return list(map(self.encoded.__getitem__, self.parts(MARK + text.replace(" ", MARK))))

    def decode(self, parts: list[str]) -> str:
        """Text of the ids, without the blank that encoding put in front."""
        return "".join(map(self.decoded.__getitem__, parts)).replace(MARK, " ")[1:]

    def rest(self) -> None:
        """Give large memos back at the end of a task: a Python worker outlives it, and lives on beside later stages."""
        if len(self.encoded) + len(self.encoded.old) > IDLE or len(self.decoded) + len(self.decoded.old) > IDLE:
            self.encoded.forget()
            self.decoded.forget()
            self.pairs.clear()
            pa.default_memory_pool().release_unused()


_models: dict[bytes, PieceModel] = {}


def model_of(data: bytes) -> PieceModel:
    """The model for these bytes, built once in each Python worker."""
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


def by_batches(batches: Iterator[pa.RecordBatch], data: bytes, schema: pa.Schema, columns: Callable[[PieceModel, list[str | None]], list[list]]) -> Iterator[pa.RecordBatch]:
    """doc_id and what ``columns`` makes of the model and some texts, for a task's batches; then the model rests."""
    model = model_of(data)
    try:
        for batch in pieces(batches, 500):
            ids, texts = columns_of(batch, "doc_id", "text")
            yield batch_of(schema, [ids, *columns(model, texts)])
    finally:
        model.rest()


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for each input row.

    Null texts count as empty: no ids, an empty decoded text.  Texts of any
    length are encoded whole.  ``model_path`` is read on the driver and its
    bytes (under 1 MB) travel with the job.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def digests(model: PieceModel, texts: list[str | None]) -> list[list]:
        def digest(text: str | None) -> tuple[int, str, str]:
            parts = model.encode(text)
            ids = ",".join(parts)
            return (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(model.decode(parts).encode("utf-8", "replace")).hexdigest())

        return list(zip(*map(digest, texts), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_batches(batches, data, _ARROW, digests)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each input row: the operator's full output."""
    with open(model_path, "rb") as f:
        data = f.read()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def full(model: PieceModel, texts: list[str | None]) -> list[list]:
        parts = list(map(model.encode, texts))
        return [[[int(i) for p in x for i in p.split(",")] for x in parts], list(map(model.decode, parts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_batches(batches, data, schema, full)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
