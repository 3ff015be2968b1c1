"""SentencePiece encoding and decoding.

All pieces form one Aho-Corasick automaton. A text runs through it once; at each position the output links
name the pieces that end there, and each relaxes the best score of the position (Viterbi). Characters that no
piece covers fall back to bytes, or to the unknown piece in models without byte pieces.

No piece of a usual model reaches over the start of a run of blanks or over a line break. Where that
holds for the loaded model (it is checked), a text is cut there and the result of each cut is kept in a
bounded table, as words repeat; otherwise the whole text is one cut. The best pieces are the same.

Defined results: null and empty texts have no pieces and decode to the empty text; decoding gives the text
back unless it holds the blank symbol U+2581 itself; the model's file is read once by the driver (its size
is bounded by MODEL_BYTES) and sent to the tasks; extra columns are kept out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from math import inf
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.support import map_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_BYTES = 64 << 20
#: Cuts whose pieces a worker remembers.
REMEMBERED = 400_000
BLANK = "▁"
#: What an uncovered character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The vocabulary: texts, scores, kinds. Built from a file on the driver; small, so it travels with the task."""

    def __init__(self, texts: list[str], scores: list[float], unknown: int, bytes_at: dict[int, int], control: set[int], prefix: bool = True) -> None:
        self.texts, self.scores, self.unknown, self.bytes_at, self.control, self.prefix = texts, scores, unknown, bytes_at, control, prefix

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Pieces:
        import sentencepiece

        if Path(path).stat().st_size > MODEL_BYTES:
            raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        if m.normalize("Ä  ﬁ") not in (f"{BLANK}Ä{BLANK * 2}ﬁ", "Ä  ﬁ"):
            raise ValueError("only models without their own normalisation are supported")
        texts = [m.id_to_piece(i) for i in ids]
        return cls(texts, [m.get_score(i) for i in ids], m.unk_id(), {int(texts[i][3:5], 16): i for i in ids if m.is_byte(i)}, {i for i in ids if m.is_control(i)})


class Known(dict):
    """word -> its pieces' ids as bytes, worked out once; emptied when it is full."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        encoder = self.encoder
        parts = encoder.joint.split(word) if encoder.joint else [word]
        if len(parts) > 1:  # a part has no joint itself
            got = self[parts[0]] + b"".join([encoder.bare[p] for p in parts[1:]])
        else:
            got = array("i", encoder.viterbi(self.before + word)).tobytes()
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got


class Encoder:
    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.auto = ahocorasick.Automaton()
        skip = {pieces.unknown, *pieces.bytes_at.values(), *pieces.control}
        normal = [i for i in range(len(pieces.texts)) if i not in skip and pieces.texts[i]]
        for i in normal:
            self.auto.add_word(pieces.texts[i], (len(pieces.texts[i]), i, pieces.scores[i]))
        self.auto.make_automaton()
        self.single = {pieces.texts[i] for i in normal if len(pieces.texts[i]) == 1}
        self.penalty = min((pieces.scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        inner = [t for t in (pieces.texts[i] for i in normal) if BLANK in t.lstrip(BLANK) or ("\n" in t and len(t) > 1)]
        self.cuts = None if inner else re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
        # where a sign follows a letter, a word can be cut as well, unless some piece holds both
        joint = re.compile(r"(?<=[^\W\d_²³¹])(?=[.,!*#%$&|])")
        self.joint = None if inner or any(joint.search(pieces.texts[i]) for i in normal) else joint
        self.after_blank, self.bare = Known(self, BLANK), Known(self, "")
        raw = [t.replace(BLANK, " ").encode() for t in pieces.texts]
        for b, i in pieces.bytes_at.items():
            raw[i] = bytes([b])
        for i in pieces.control:
            raw[i] = b""
        raw[pieces.unknown] = " ⁇ ".encode()
        self.raw = raw

    def viterbi(self, cut: str) -> list[int]:
        """Best pieces of one cut; of equal scores the one whose last piece starts first."""
        n = len(cut)
        best, start, piece = [0.0, *[-inf] * n], [0] * (n + 1), [-1] * (n + 1)
        if self.single.issuperset(cut):
            for end, (size, i, score) in self.auto.iter(cut):
                s = best[end + 1 - size] + score
                if s > best[end + 1]:
                    best[end + 1], start[end + 1], piece[end + 1] = s, end + 1 - size, i
        else:
            self._with_unknown(cut, best, start, piece)
        out: list[int] = []
        while n:
            a, i = start[n], piece[n]
            if i >= 0:
                out.append(i)
            elif self.p.bytes_at:
                out.extend([self.p.bytes_at[b] for b in reversed(cut[a:n].encode("utf-8", "replace"))])
            else:
                out.append(self.p.unknown)
            n = a
        return out[::-1]

    def _with_unknown(self, cut: str, best: list, start: list, piece: list) -> None:
        done = 0

        def close(upto: int) -> None:
            """A character without a piece of its own may stand alone, at a price."""
            nonlocal done
            while done < upto:
                if cut[done] not in self.single and best[done] + self.penalty > best[done + 1]:
                    best[done + 1], start[done + 1] = best[done] + self.penalty, done
                    piece[done + 1] = -1
                done += 1

        for end, (size, i, score) in self.auto.iter(cut):
            close(end)
            s = best[end + 1 - size] + score
            if s > best[end + 1]:
                best[end + 1], start[end + 1], piece[end + 1] = s, end + 1 - size, i
        close(len(cut))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        out: list[bytes] = []
        if self.cuts is None:
            out.append(array("i", self.viterbi((BLANK if self.p.prefix else "") + text.replace(" ", BLANK))).tobytes())
            text = ""
        for k, line in enumerate(text.split("\n")) if text else ():
            if k:
                out.append(self.bare["\n"])
            if "  " in line or line[:1] in ("", " ", BLANK) or line[-1:] == " " or BLANK in line:
                line = (BLANK if self.p.prefix and not k else "") + line.replace(" ", BLANK)
                out.extend(map(self.bare.__getitem__, self.cuts.findall(line)))
                continue
            words = line.split(" ")
            if k or not self.p.prefix:
                out.append(self.bare[words[0]])
                del words[0]
            out.extend(map(self.after_blank.__getitem__, words))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        raw = self.raw
        text = str(b"".join([raw[i] for i in ids]), "utf-8", "replace")
        return text[1:] if self.p.prefix and text[:1] == " " else text


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(pieces: Pieces) -> Encoder:
    """One encoder for each vocabulary in a worker, kept over tasks with the words it knows."""
    key = hash((tuple(pieces.texts), tuple(pieces.scores)))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(pieces)
    return _ENCODERS[key]


def _encode(pieces: Pieces, decoded: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(pieces)
        for b in batches:
            found = [encoder.encode(t or "") for t in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
            texts = [pa.array([encoder.decode(f.tolist()) for f in found], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids, *texts], ["id", "text", "ids", *["decoded"] * decoded])

    return run


def _decode(pieces: Pieces):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(pieces)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            at = np.asarray(lists.offsets)
            flat, at = np.asarray(lists.flatten()).tolist(), at - at[0]  # of a slice, not of the whole batch
            texts = [encoder.decode(flat[at[k] : at[k + 1]]) for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id, text and ids (array of int) of every row; if asked for, also decoded, as decode() adds it, without a second worker that holds the vocabulary."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])])
    return map_batches(rows, _encode(pieces, decoded), schema)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """The rows of encode() with the text that the ids stand for, in column decoded; nulls must not be in ids."""
    return map_batches(encoded, _decode(pieces), T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())]))
