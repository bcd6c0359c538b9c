"""SentencePiece encoding by a streaming Viterbi, and decoding.

The lattice is walked one character at a time.  A position is alive while the text since
then is the beginning of a longer piece, so the window is bounded by the longest piece;
the text since the first alive position tells the others, so the model remembers, for it
and the next character, the pieces that end there and the text alive after it.  Once all
backpointer paths of the alive positions pass one boundary, the ids before it are
committed and forgotten.  For a unigram model a position keeps its best-scoring last
piece.  For a BPE model it keeps the one last piece that the merges would leave there:
the merges' segmentation of a text is the only one in which each neighbouring pair of
pieces is what the merges make of that pair alone, so a pair test replaces the score.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import documents, map_batches
from ._words import Memo, encode_distinct
from .word_bpe import PUNCTUATION

BLANK = "▁"
UNIGRAM, BPE = 1, 2
#: Pair tests remembered, some 100 bytes each, and steps of the window, some 300.
PAIRS, STEPS = 400_000, 200_000
PIECE, BEGINNING = 1, 2


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at:at + n]
            at += n


class _Alive(dict):
    """The longest beginning of a piece that ends at a position, and the steps from it by each next character."""

    __slots__ = ("step", "text")

    def __init__(self, step: Callable[[_Alive, str], tuple], text: str):
        super().__init__()
        self.step, self.text = step, text

    def __missing__(self, c: str) -> tuple:
        return self.step(self, c)


class PieceModel:
    """The pieces, scores and normalisation of a model file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None, memo: int = 160 << 20, parts: int = 32 << 20):
        from sentencepiece import SentencePieceProcessor
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        self.lib = lib = SentencePieceProcessor(model_proto=proto)
        spec = dict(_fields(proto))
        self.kind = dict(_fields(spec.get(2, b""))).get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        norm = dict(_fields(spec.get(3, b"")))
        #: Text is taken as it is, with a blank before it and blanks shown as U+2581.
        self.plain = not norm.get(2) and norm.get(3, 1) == 1 and norm.get(4, 1) == 0 and norm.get(5, 1) == 1
        n = lib.get_piece_size()
        special = lambda i: lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)
        self.ids = {lib.id_to_piece(i): i for i in range(n) if not special(i)}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        #: What a text can be to the lattice: a piece, the beginning of a longer one, or both.
        self.forms = dict.fromkeys(self.ids, PIECE)
        for p in self.ids:
            for k in range(1, len(p)):
                self.forms[p[:k]] = self.forms.get(p[:k], 0) | BEGINNING
        self.longest = max(map(len, self.ids))
        self.unknown, self.unknown_score = lib.unk_id(), min(self.scores.values()) - 10
        found = {lib.id_to_piece(i): i for i in range(n) if lib.is_byte(i)}
        self.bytes = [found[f"<0x{b:02X}>"] for b in range(256)] if len(found) == 256 else None
        #: Neighbours inside pieces: between other characters no piece can stand.
        self.inside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: Texts may be cut between such neighbours (without byte pieces, a run of unknown characters is one unknown).
        self.cuts = self.kind == BPE and self.bytes is not None
        #: Punctuation that no piece has behind a letter.
        self.closing = "".join(c for c in PUNCTUATION if self.cuts and not any(p[0].isalpha() and p[1] == c for p in self.inside))
        self.chunked = all(BLANK not in p.lstrip(BLANK) for p in self.ids)
        self.newline_cuts = self.chunked and not any("\n" in p for p in self.ids)
        text = [lib.id_to_piece(i).replace(BLANK, " ").encode() for i in range(n)]
        for i in range(n):
            if lib.is_control(i):
                text[i] = b""
            elif lib.is_unknown(i):
                text[i] = " ⁇ ".encode()
            elif lib.is_byte(i):
                text[i] = bytes([int(lib.id_to_piece(i)[3:5], 16)])
        self.table = pa.array(text, pa.large_binary())
        #: Codes of the walk: 0 is the start, then the pieces, then a code for each other character.
        self.names = ["", *self.ids]
        self.codes = {p: i for i, p in enumerate(self.names) if p}
        self.span = len(self.names) + 0x110000
        self.pairs: dict[int, bool] = {}
        self.root, self.alive, self.steps = _Alive(self._step, ""), {}, 0
        self.memo, self.parts = Memo(self._chunk, memo), Memo(self._packed, parts)

    def merge(self, text: str) -> list[str]:
        """The merges on a short text: the best-scoring neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            made = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not made:
                break
            i = min(made)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def name(self, code: int) -> str:
        return self.names[code] if code < len(self.names) else chr(code - len(self.names))

    def code(self, c: str) -> int:
        return self.codes.get(c) or len(self.names) + ord(c)

    def stands(self, pair: int) -> bool:
        """Whether the merges leave a piece as it is after the one before it (``span`` times that one's code and its own)."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        before, piece = map(self.name, divmod(pair, self.span))
        ok = self.pairs[pair] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return ok

    def _step(self, alive: _Alive, c: str) -> tuple[tuple[tuple[int, int], ...], _Alive]:
        """The pieces that end with ``c`` (length and code, longest first) and what is alive after it."""
        if self.steps >= STEPS:
            for known in [self.root, *self.alive.values()]:
                known.clear()
            self.alive, self.steps = {}, 0
        text = alive.text + c
        tails = [text[k:] for k in range(len(text))]
        ends = tuple((len(t), self.codes[t]) for t in tails if self.forms.get(t, 0) & PIECE)
        rest = next((t for t in tails if self.forms.get(t, 0) & BEGINNING), "")
        after = self.alive.setdefault(rest, _Alive(self._step, rest)) if rest else self.root
        alive[c] = out = ends, after
        self.steps += 1
        return out

    def piece_ids(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode("utf-8")] if self.bytes else [self.unknown]

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """The ids of a normalised text, each as soon as it is certain."""
        out: list[int] = []
        for _ in self._walk(chars, out):
            yield from out
            out.clear()

    def _walk(self, chars: Iterable[str], out: list[int]) -> Iterator[None]:
        """Appends the ids of a normalised text to ``out``; stops whenever some have been committed."""
        base, at, alive = 0, 0, self.root  # the window's start, the position reached
        last, score = [0], [0.0]           # per position of the window: last piece, best score
        bpe, names, ids, pairs, stands, span = self.kind == BPE, self.names, self.ids, self.pairs, self.stands, self.span
        named = len(names)
        after_unknown = False

        def commit(upto: int) -> None:
            nonlocal base, after_unknown
            path, end = [], upto - base
            while end > 0:
                path.append(piece := names[last[end]] if last[end] < named else self.name(last[end]))
                end -= len(piece)
            for piece in reversed(path):
                i = ids.get(piece)
                if i is not None:
                    out.append(i)
                    after_unknown = False
                else:
                    if self.bytes or not after_unknown:  # a run of unknown characters is one unknown
                        out.extend(self.piece_ids(piece))
                    after_unknown = True
            cut = upto - base
            base = upto
            del last[:cut], score[:cut]

        for c in chars:
            ends, alive = alive[c]
            at += 1
            if bpe:
                for size, code in ends:
                    pair = last[-size] * span + code
                    ok = pairs.get(pair)
                    if stands(pair) if ok is None else ok:
                        break
                else:
                    code = self.code(c)
            else:
                code, best = None, 0.0
                for size, piece in ends:
                    s = score[-size] + self.scores[names[piece]]
                    if code is None or s > best:
                        code, best = piece, s
                unknown = score[-1] + self.unknown_score
                if code is None or c not in ids and unknown > best:
                    code, best = self.code(c), unknown
                score.append(best)
            last.append(code)
            if alive is self.root:
                commit(at)
                yield
            elif at - base >= 64 and at % 16 == 0:
                # The last boundary that every alive position's path passes.
                common = None
                for k in range(len(alive.text) + 1):
                    if k < len(alive.text) and not self.forms.get(alive.text[k:], 0) & BEGINNING:
                        continue
                    e = at - base - len(alive.text) + k
                    path = {e}
                    while e > 0:
                        e -= len(self.name(last[e]))
                        path.add(e)
                    common = path if common is None else common & path
                if (to := max(common)) > 0:
                    commit(base + to)
                    yield
        commit(at)
        yield

    def encode_ids(self, normalised: str) -> list[int]:
        out: list[int] = []
        for _ in self._walk(normalised, out):
            pass
        return out

    def _packed(self, normalised: str) -> bytes:
        return array("i", self.encode_ids(normalised)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk between blanks; one that begins with a newline had no blank before it."""
        return self._raw(chunk if chunk[:1] == "\n" or chunk[:1] == BLANK else BLANK + chunk)

    def _raw(self, text: str) -> bytes:
        """Ids of a normalised text, cut where no piece can stand across."""
        if len(text) > 64 or not self.cuts or self.inside.issuperset(map(add, text, text[1:])):
            return self._packed(text)
        ends = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.inside]
        return b"".join([self.parts[text[i:j]] for i, j in zip([0, *ends], [*ends, len(text)])])

    def _distinct(self, chunks: pa.DictionaryArray) -> list[bytes]:
        """Ids of each distinct chunk; a run of letters and the punctuation behind it are encoded on their own."""
        words = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        cores = [w.rstrip(self.closing) for w in words]
        cores = [c if c.isalpha() or c[:1] == "\n" and c[1:].isalpha() else w for w, c in zip(words, cores)]
        memo, parts = self.memo, self.parts
        return [memo[c] if len(c) == len(w) else memo[c] + parts[w[len(c):]] for w, c in zip(words, cores)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not (self.plain and self.newline_cuts):
            return [self._packed(self.lib.normalize(t)) if t else b"" for t in texts.to_pylist()]
        out = encode_distinct(pc.replace_substring(texts, "\n", " \n"), self._distinct)
        odd = pc.match_substring_regex(texts, f"  |^ | \n|{BLANK}| $").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():  # runs of blanks belong to one chunk
            text = BLANK + texts[i].as_py().replace(" ", BLANK)
            out[i] = b"".join(self._raw(c) for c in re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", text))
        for i in np.flatnonzero(pc.equal(texts, "").to_numpy(zero_copy_only=False)).tolist():
            out[i] = b""
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: bytes put together, the blank in front taken off."""
        return self.decode_all([np.asarray(ids, np.int64)])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        pieces = self.table.take(pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)))
        at = np.frombuffer(pieces.buffers()[1], np.int64)[:len(pieces) + 1]
        data = memoryview(pieces.buffers()[2] or b"")
        ends = at[np.cumsum([0, *map(len, ids)])].tolist()
        texts = (bytes(data[a:b]).decode("utf-8", errors="replace") for a, b in zip(ends, ends[1:]))
        return [t[1:] if t[:1] == " " else t for t in texts]


@functools.lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


#: Rows worked on at a time: bounds the buffers beside the batch.
ROWS = 1000


def _ids_array(ids: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, text, ids): every text's piece ids; with ``decode`` also ``decoded``, their text.

    Null and empty texts have no ids; a null doc_id stays null; repeated rows are encoded
    like any other; an empty table gives no rows.  A word without end is streamed like
    any text: memory is bounded by the longest piece.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(path)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                ids = m.encode(part.column(1))
                cols = [*part.columns, _ids_array(ids)]
                if decode:
                    cols.append(pa.array(m.decode_all([np.frombuffer(x, "<i4") for x in ids]), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "ids", "decoded"][:len(cols)])
    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(
        run, "doc_id long, text string, ids array<int>" + (", decoded string" if decode else ""))


def decode_documents(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of its ids (null ids: empty)."""
    path = model or default_model()
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.asarray(x or [], np.int64) for x in b.column(ids_col).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(piece_model(path).decode_all(ids), pa.string())],
                                          names=[*b.schema.names, "decoded"])
    return map_batches(encoded, run, schema)
