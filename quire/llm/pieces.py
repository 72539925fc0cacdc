"""SentencePiece encoding and decoding over a lattice of pieces.

For each word (spaces and the run of letters, or of other characters, that
follows) the substrings of at most the longest piece's length are looked up in
the piece table as edges, in Python over the distinct words of an Arrow batch and
not by Spark's explode, join and group; a Viterbi fold picks the path.  The installed model is a byte-pair one, whose scores rank merges: the
sum of scores would not give its segmentation.  So an edge extends a path only if
the two pieces are stable, that is, if merging their joint text yields just these
two.  With that weight exactly one path reaches each end, the model's own.
Models of the unigram kind keep the usual fold, the greatest sum of scores.

No piece spans the border of two words or holds a character outside the
vocabulary, so texts are cut there without changing the result; both facts
are checked when the table is built.  Characters outside it become their bytes.
The lattice of a batch covers its distinct words only, and a bounded cache
serves words met before.  The relation that joins words back to their places
stays inside the batch: a shuffle by word would move every place of every word.

Defined results: a null or empty text has no tokens and decodes to the empty
text; U+2581 is a space to the model, as in the library; repeated rows each get
a row; a null doc_id is kept; very long texts are encoded whole, word by word; of
unigram paths with equal sums (ties) the first found stays; an empty table gives an
empty result; any further columns, whatever their names, are ignored.  A model whose
segmentation of a few probing texts differs from the library's is refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Texts that tell models of other kinds: blanks, case, widths, ligatures, accents in two forms, digits, controls.
PROBES = ("the quick brown fox", "  two  blanks ", "Tab\tand\nline", "ＡＢ１ ﬁ ² ½ ① ﷺ", "e\u0301 é İ ẞ", "1234567890 3.14", "x\u200b\u00ad\u00a0y\u3000z", "漢字かな 한글 😀", "\x01 \x7f", "antidisestablishmentarianism")
CACHE_WORDS = 300_000
_NONE = float("-inf")


def merge(text: str, rank: dict[str, float]) -> list[str]:
    """Byte-pair merging of a short text: the best-ranked neighbours first, leftmost among equals."""
    parts = list(text)
    while True:
        best, at = _NONE, -1
        for k in range(len(parts) - 1):
            score = rank.get(parts[k] + parts[k + 1], _NONE)
            if score > best:
                best, at = score, k
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class PieceTable:
    """A model's pieces, as the lattice needs them.  Small enough to broadcast: it is bounded by the vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, str]], bpe: bool, dummy_prefix: bool = True):
        """pieces: (text, score, kind) by id; kind is normal, byte, unknown or other."""
        self.bpe, self.dummy_prefix = bpe, dummy_prefix
        normal = {p: (k, s) for k, (p, s, kind) in enumerate(pieces) if kind == "normal"}
        self.score = {p: s for p, (_, s) in normal.items()}
        reach = {p for p in normal if not bpe or merge(p, self.score) == [p]}
        self.ids = {p: k for p, (k, _) in normal.items() if p in reach}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == "unknown"), 0)
        #: The join's right side: pieces with their ids, and what only begins a piece with -1.
        self.join = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.longest = max(map(len, self.ids), default=0)
        self.surface = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode() if kind == "normal" else b" \xe2\x81\x87 " if kind == "unknown" else b"" for p, _, kind in pieces]
        known = set("".join(self.ids)) - {SPACE}
        if any(SPACE in p.lstrip(SPACE) or p[0] == SPACE and not p.strip(SPACE) and set(p) != {SPACE} for p in self.ids):
            raise ValueError("a piece spans two words")
        self.chars, letters = known, {c for c in known if c.isalpha()}
        # If no piece holds a letter next to another character, words are cut between the two as well.
        mixes = any((a in letters) != (b in letters) for p in self.ids for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:]))
        self.parts = [known] if mixes else [letters, known - letters]

    @classmethod
    def load(cls, path: str = MODEL) -> PieceTable:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = lambda k: "byte" if model.is_byte(k) else "unknown" if model.is_unknown(k) else "other" if model.is_control(k) or model.is_unused(k) else "normal"
        pieces = [(model.id_to_piece(k), model.get_score(k), kinds(k)) for k in range(model.get_piece_size())]
        whole = [s for p, s, kind in pieces if kind == "normal" and len(p) > 1]
        out = cls(pieces, bpe=all(s == int(s) for s in whole))
        # A model that normalises texts, adds no blank in front or is of another kind is told by these.
        lattice = Lattice(out)
        for text in PROBES:
            if lattice.encode(text).tolist() != model.encode(text):
                raise ValueError(f"this model does not cut {text!r} as its pieces say: its normaliser or kind is not known here")
        return out


class Lattice:
    """Encodes words against a piece table; keeps what it has learned, within bounds."""

    def __init__(self, table: PieceTable):
        # Words of the present and of the former generation: frequent ones move along, rare ones go.
        self.table, self.words, self.former, self.stable = table, {}, {}, {}
        # Characters outside the vocabulary stand alone: they can be part of no edge.
        known = re.escape("".join(sorted(table.chars)))
        runs = "|".join(f"{SPACE}*[{re.escape(''.join(sorted(part)))}]+" for part in table.parts if part)
        self.cut = re.compile(f"{runs}|{SPACE}+|[^{known}{SPACE}]")

    def edges(self, word: str) -> list[tuple[int, int, str]]:
        """(start, end, piece) of all substrings that are pieces, by start; a start is given up at the first substring that begins no piece."""
        out, get, n = [], self.table.join.get, len(word)
        for a in range(n):
            for b in range(a + 1, n + 1):
                known = get(piece := word[a:b])
                if known is None:  # at the latest one past the longest piece
                    break
                if known >= 0:
                    out.append((a, b, piece))
        return out

    def fits(self, left: str, right: str) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) > 2 * CACHE_WORDS:
                self.stable.clear()
            known = self.stable[left, right] = merge(left + right, self.table.score) == [left, right]
        return known

    def fold(self, word: str, edges: list[tuple[int, int, str]]) -> list[int]:
        """Viterbi over the edges in order of their starts: when a start is reached, its best path is known."""
        table, n = self.table, len(word)
        before: list[tuple[int, str] | None] = [(-1, "")] + [None] * n
        if table.bpe:
            for start, end, piece in edges:
                if before[end] is None and (left := before[start]) is not None and (not start or self.fits(left[1], piece)):
                    before[end] = (start, piece)
        else:
            best = [0.0] + [_NONE] * n
            for start, end, piece in edges:
                if (score := best[start] + table.score[piece]) > best[end]:
                    best[end], before[end] = score, (start, piece)
        if before[n] is None:
            return [x for c in word for x in self.fallback(c)]
        out, at = [], n
        while at:
            at, piece = before[at]
            out.append(table.ids[piece])
        return out[::-1]

    def fallback(self, char: str) -> list[int]:
        if char in self.table.ids:
            return [self.table.ids[char]]
        return [self.table.bytes.get(b, self.table.unknown) for b in char.encode()] if self.table.bytes else [self.table.unknown]

    def learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > CACHE_WORDS:
            self.former, self.words = self.words, {}
        for word in words:
            known = self.former.get(word)
            if known is None:
                ids = self.fold(word, self.edges(word))
                known = struct.pack(f"={len(ids)}i", *ids)
            self.words[word] = known

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        words = self.cut.findall((SPACE if self.table.dummy_prefix else "") + text.replace(" ", SPACE))
        distinct = set(words)
        if fresh := distinct.difference(self.words):
            self.learn(distinct if len(self.words) + len(fresh) > CACHE_WORDS else fresh)
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.table.surface.__getitem__, ids.tolist()))
        if self.table.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_LATTICES: dict[PieceTable, Lattice] = {}


def _lattice(shared) -> Lattice:
    """One for each model in each worker process, kept between tasks."""
    if shared.value not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[shared.value] = Lattice(shared.value)
    return _LATTICES[shared.value]


def table_of(spark: SparkSession, path: str = MODEL):
    return spark.sparkContext.broadcast(PieceTable.load(path))


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_tokens, token_ids, round_trip for each row; round_trip compares the decoded text."""
    bounded_batches(docs.sparkSession)
    shared = table_of(docs.sparkSession, model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [lattice.encode(t) for t in texts]
            same = [lattice.decode(x) == t.replace(SPACE, " ") for x, t in zip(ids, texts)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_tokens", "token_ids", "round_trip"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(encode, "doc_id bigint, n_chars bigint, n_tokens bigint, token_ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with token_ids (null: the empty text)."""
    bounded_batches(tokens.sparkSession)
    shared = table_of(tokens.sparkSession, model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            texts = [lattice.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", F.col("token_ids")).mapInArrow(decode, "doc_id bigint, text string")
