"""SentencePiece encoding and decoding with a weighted finite-state transducer over the tropical semiring.

Compiled from a SentencePiece model once:

* the normaliser, a transducer of two states: the first puts U+2581 in front, the second maps a blank to
  U+2581 and each other character to itself (models with other rules are refused);
* the pieces, a transducer whose states are the prefixes of pieces: an arc for each character, and a final
  state for each piece, with its id and its weight, minus its score;
* the byte fallback: from the first state, a default arc for a character that is no piece, to its UTF-8
  bytes' ids (or the unknown id), with the weight ``FALLBACK``.

An input is composed with the normaliser and then with the closure of the other two. The states of the
composed machine are (position, last piece); a path's weight is the sum of its arcs' weights and of its
transitions'. ``path`` relaxes all arcs in the order of positions, (min, +) over each state, and returns the ids of
the shortest path.

For unigram models all transitions weigh 0 and the last piece is no part of a state. For merge-based
models (BPE) sums of scores alone do not give the ids of merging, so there a transition between two
neighbouring pieces weighs 0 if merging their joint characters by score yields just these two pieces,
else infinity. That local condition is exact: merging yields a sequence of pieces if and only if it yields
each neighbouring pair on its own, since up to the first merge across a boundary both run alike.

No piece holds U+2581 after another character, nor a line feed, nor a full stop or the like after a
letter (all this is checked when a model is compiled), so the composed machine passes through one
state at each such place: inputs are composed word by word, and a worker remembers the paths of short words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.text_features import slices

BLANK, UNKNOWN = "▁", " ⁇ ".encode()
MEMO, MEMO_CHARS = 800_000, 40
LETTER = r"[^\W\d_]"
FALLBACK, INFINITE = 1e6, float("inf")
BREAKS = ".,;:!?|"  # signs at which a run of letters is cut, those of them that no piece joins to a letter before


class Transducer:
    """The machine of pieces: ``pieces`` maps a surface to (id, weight), ``byte`` a byte to its id.

    ``merges``: neighbouring pieces must be what merging leaves of them; the least weight merges first.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte: dict[int, int] | None = None, unknown: int = 0, merges: bool = True):
        self.piece, self.byte, self.unknown, self.merges = pieces, byte or {}, unknown, merges
        self.start: dict = {}  # states are dicts: arcs by character, and under "" the (piece, weight) that ends there
        for p, (_, weight) in pieces.items():
            state = self.start
            for c in p:
                state = state.setdefault(c, {})
            state[""] = (p, weight)
        # the words split at blanks and line feeds only if the pieces allow it
        self.splits = not any("\n" in p or BLANK in p.lstrip(BLANK) or (p.startswith(BLANK * 2) and p.strip(BLANK)) for p in pieces)
        joined = {b for p in pieces for a, b in re.findall(f"(?=({LETTER})([^\\w\\s]))", p)}
        breaks = re.escape("".join(c for c in BREAKS if c not in joined))
        ends = f"[{BLANK}\n{breaks}]"
        cut = f"{BLANK}*{LETTER}+(?={ends}|\\Z)|[{breaks}][^{BLANK}\n]*|" if breaks else ""
        self.words = re.compile(f"{cut}\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+").findall
        self.steps: dict[str, dict[str, float]] = {}
        self.known = 0
        self.memo: dict[str, bytes] = {}
        self.surface: list[bytes] = []

    @classmethod
    def of_model(cls, path: str) -> Transducer:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("a  ½ﬁ\n") != f"{BLANK}a{BLANK}{BLANK}½ﬁ\n":
            raise ValueError("only models whose normaliser is the identity with a blank in front can be compiled")
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        names = [model.id_to_piece(i) for i in ids]
        byte = {int(names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        pieces = {names[i]: (i, -model.get_score(i)) for i in ids if not special[i] and not model.is_byte(i)}
        # merged pieces have whole ranks as scores, unigram ones log probabilities
        machine = cls(pieces, byte, model.unk_id(), all(w == int(w) for _, w in pieces.values()))
        # surface of each id, for decoding; control pieces have none
        machine.surface = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(BLANK, " ").encode() for i in ids]
        machine.surface[machine.unknown] = UNKNOWN
        return machine

    def merged(self, text: str) -> list[str]:
        """Pieces that merging by weight leaves of a short text (two pieces at most)."""
        parts, piece = list(text), self.piece
        while len(parts) > 1:
            best, where = INFINITE, -1
            for i in range(len(parts) - 1):
                found = piece.get(parts[i] + parts[i + 1])
                if found is not None and found[1] < best:
                    best, where = found[1], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def transition(self, left: str, right: str) -> float:
        """Weight of the transition from a piece (none at the start) to another: 0 or infinite."""
        if not self.merges or self.merged(left + right) == ([left, right] if left else [right]):
            return 0.0
        return INFINITE

    def path(self, word: str) -> tuple[list[str], float]:
        """Surfaces and weight of the shortest path of a normalised word."""
        if self.known > MEMO:
            self.steps, self.known = {}, 0
        size, merges = len(word), self.merges
        ahead: list[dict[str, tuple[float, str, str]]] = [{} for _ in range(size + 1)]
        ahead[0][""] = (0.0, "", "")  # by state at a position: weight, last surface, state before
        for at in range(size):
            for before, (so_far, _, _) in ahead[at].items():
                steps = self.steps.get(before)
                if steps is None:
                    steps = self.steps[before] = {}
                arcs, state, i = [], self.start, at
                while i < size:
                    state = state.get(word[i])
                    if state is None:
                        break
                    i += 1
                    if "" in state:
                        arcs.append(state[""])
                if not arcs or len(arcs[0][0]) > 1:
                    arcs.append((word[at], FALLBACK))  # the default arc
                for arc, weight in arcs:
                    step = steps.get(arc)
                    if step is None:
                        step = steps[arc] = self.transition(before, arc)
                        self.known += 1
                    if step < INFINITE:
                        total, there, name = so_far + step + weight, ahead[at + len(arc)], arc if merges else ""
                        if name not in there or total < there[name][0]:
                            there[name] = (total, arc, before)
        state, (weight, *_) = min(ahead[size].items(), key=lambda s: s[1][0])
        at, taken = size, []
        while at:
            _, arc, state = ahead[at][state]
            taken.append(arc)
            at -= len(arc)
        return taken[::-1], weight

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for arc in self.path(word)[0]:
            found = self.piece.get(arc)
            if found is not None:
                out.append(found[0])
            elif self.byte:
                out.extend(self.byte[b] for b in arc.encode())
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        if len(self.memo) > MEMO:
            self.memo.clear()
        normal, memo = BLANK + text.replace(" ", BLANK), self.memo
        words = self.words(normal) if self.splits else [normal]
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            pass
        rare = {}
        for w in words:
            if w not in memo and w not in rare:
                (memo if len(w) <= MEMO_CHARS else rare)[w] = np.array(self.ids(w), "<u4").tobytes()
        return b"".join([memo[w] if w in memo else rare[w] for w in words])

    def decode(self, ids: bytes) -> str:
        """The text of ids, by the inverse machine: surfaces and bytes joined, the blank in front dropped.

        An id that the model does not have counts as unknown; up to three bytes after the last whole id are left out.
        """
        surface, size = self.surface, len(self.surface)
        raw = b"".join([surface[i] if i < size else UNKNOWN for i in np.frombuffer(ids, "<u4", len(ids) // 4).tolist()])
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


@cache
def transducer(path: str) -> Transducer:
    return Transducer.of_model(path)


def encode_texts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and ``ids`` (binary, little-endian 32 bits). Null and empty texts have none.

    Rows with null or repeated ids, and repeated rows, are encoded like any other; other columns are left
    out, so none can clash. Texts go through word by word (of a long one the memory is that of its ids).
    """
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            for a, b in slices(batch.column(2).to_pylist()):
                ids = [machine.encode(t) for t in batch.column(1)[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).alias("bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary").withColumnRenamed("doc_id", id_col)


def decode_ids(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Each row's id, ``ids`` and ``text``; null ids are an empty text, ids that the model does not have are unknown ones."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            texts = [machine.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, text string").withColumnRenamed("doc_id", id_col)


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and checksums of ids and texts."""
    return decoded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
