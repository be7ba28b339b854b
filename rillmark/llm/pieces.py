"""SentencePiece BPE encoding and decoding that keeps byte offsets.

``Normalizer`` rewrites a text by longest-prefix replacement through the model's compiled
character map (a double array of unit words followed by the replacement strings) and records for
every normalised byte the original byte it comes from. The normalised text falls into chunks at
every space mark behind another character and around line ends (no piece crosses there); chunks that this
worker doesn't know are merged together as one ragged array (``ragged``), and the rest of the
normalised text is looked up. A worker knows some ``MEMO`` chunks: when there are more it forgets the less used half, so
that common ones are merged once. The pieces of many texts are one array, from which their numbers in decimal and their bytes are
taken at once. Every piece is projected to the span of original bytes it covers; the spans of a text tile it.

Defined results: a null text is empty and has the end id only, which decodes to an empty text; very long texts are
encoded whole, by one task each; rows are independent, so ties, repeated rows and empty tables need no rule; columns other than
those named are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memo, table
from .ragged import PairTable, merge_all, merge_one

SPACE = "▁"
DOUBLE = SPACE * 2
#: Chunks that a worker knows, and pieces of a chunk that it remembers.
MEMO, LONG = 400_000, 64
CHUNKS = 20_000
#: Pieces whose bytes are put together at once.
SLICE = 1 << 20
#: Kinds of piece in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharMap:
    """Longest-prefix replacement by a compiled character map; empty maps replace nothing."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if len(blob) > 4:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this place and its replacement."""
        units, found = self.units, None
        node, i = 0, at
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        while i < len(data):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            i += 1
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (i - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]


class Normalizer:
    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.mark = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.identity = not self.map.units and not self.squeeze and self.mark

    def __call__(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text and, for each of its bytes and for its end, the original byte.

        With an identity map the alignment follows from the text alone and None stands for it:
        the added prefix covers nothing and every space mark covers one byte or, where the text
        holds the mark itself, three.
        """
        if not text:
            return "", np.zeros(1, np.int64)
        if self.identity:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), None
        data = text.encode()
        out, source, at = bytearray(), [], 0
        space = SPACE.encode() if self.mark else b" "

        def put(piece: bytes, start: int) -> None:
            out.extend(piece)
            source.extend([start] * len(piece))

        units: list[tuple[bytes, int, int]] = []
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units else None
            if hit is None:
                lead = data[at]
                size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                hit = size, data[at : at + size]
            units.append((hit[1], at, at + hit[0]))
            at += hit[0]
        if self.squeeze:
            while units and units[0][0].strip(b" ") == b"":
                units.pop(0)
        started = False
        blank = self.squeeze
        for piece, start, _ in units:
            if not started:
                if self.prefix:
                    put(space, start)
                started = True
            for ch in piece.decode():
                if ch == " ":
                    if not blank or not self.squeeze:
                        put(space, start)
                    blank = True
                else:
                    put(ch.encode(), start)
                    blank = False
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], source[-len(space) :]
        return out.decode(), np.array([*source, len(data)], np.int64)


def taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Coded(NamedTuple):
    """Pieces of texts, the end id of each among them, and the normalised bytes they cover; text i has those from ``bounds[i]`` to ``bounds[i + 1]``."""

    ids: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray


class Encoder:
    """Encodes and decodes texts. ``place`` numbers the chunks of normalised text that are known; None stands for a text's end."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.normalizer = Normalizer(model.normalizer_spec)
        self.squeeze, self.prefix = model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix
        pieces = model.pieces
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.unknown_text = model.trainer_spec.unk_surface
        self.end = next((i for i, p in enumerate(pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>")), -1)
        self.kind = [p.type for p in pieces]
        self.text = [p.piece for p in pieces]
        self.byte_ids = [-1] * 256
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.fallback = model.trainer_spec.byte_fallback
        if any(p.type in (USER, UNUSED) for p in pieces) or model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models without user-defined and unused pieces are encoded")
        usable = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.chars = {c: usable.get(c, -1) for c in {c for p in usable for c in p}}
        self.outside = len(pieces)  # symbols from here on are single characters that are no piece
        extra = [c for c, i in self.chars.items() if i < 0]
        self.chars.update((c, self.outside + k) for k, c in enumerate(extra))
        self.extra = extra
        symbol = {**usable, **{c: self.chars[c] for c in extra}}
        # the better score goes first; equal scores have one rank, so that the leftmost goes first
        ranks = {s: r for r, s in enumerate(sorted({pieces[i].score for i in usable.values()}, reverse=True))}
        pairs = {}
        for text, i in usable.items():
            for cut in range(1, len(text)):
                a, b = symbol.get(text[:cut]), symbol.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (ranks[pieces[i].score], i)
        self.table = PairTable(pairs)
        self.sizes = np.array([*(len(t.encode()) for t in self.text), 0], np.int32)
        self.sizes[[i for i, k in enumerate(self.kind) if k == BYTE]] = 1
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for c, i in self.chars.items():
            if i < self.outside:
                self.symbol_of[ord(c)] = i
        crossing = any(SPACE in p.lstrip(SPACE) for p in usable)
        self.alone = alone = "".join(c for c in "\n\t\r" if c not in self.chars)  # no piece holds them
        self.cut = None if crossing else regex.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]" * bool(alone))
        self.piece_bytes = [b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else self.unknown_text.encode() if k == UNKNOWN else t.replace(SPACE, " ").encode() for k, t in zip(self.kind, self.text, strict=True)]
        numbers = [f"{i} ".encode() for i in [*range(len(pieces)), -1]]  # a model without an end id has -1
        self.digits = np.array(numbers, f"S{max(map(len, numbers))}").view(np.uint8).reshape(len(numbers), -1)
        self.bytes_of = np.frombuffer(b"".join(self.piece_bytes), np.uint8)
        self.byte_sizes = np.array([*map(len, self.piece_bytes), 0], np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.place: dict[str | None, int] = defaultdict(count(1).__next__, {None: 0})
        #: Of the known chunks: pieces and their lengths, flat; how many, where they begin, and the chunk's use.
        self.ids, self.lengths = np.array([self.end], np.int32), np.zeros(1, np.int32)
        self.counts, self.starts, self.used = np.ones(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _slow(self, chunk: str) -> tuple[list[int], list[int]]:
        """Pieces of a chunk merged one pair at a time, and their lengths; characters in no piece stand alone."""
        top, strange, symbols = self.outside + len(self.extra), {}, []
        for c in chunk:
            s = self.chars.get(c)
            if s is None:
                s = top + len(strange)
                strange[s] = c
            symbols.append(s)
        ids, sizes = [], []
        for s in merge_one(symbols, self.table):
            if s < self.outside:
                ids.append(s)
                sizes.append(int(self.sizes[s]))
                continue
            data = (strange.get(s) or self.extra[s - self.outside]).encode()
            ids.extend([self.byte_ids[b] for b in data] if self.fallback else [self.unknown])
            sizes.extend([1] * len(data) if self.fallback else [len(data)])
        return ids, sizes

    def _merged(self, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of chunks and their lengths, flat, and how many each has. Chunks whose characters are all pieces, and that don't
        begin with two marks (runs of marks have pieces of equal score), are merged together."""
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[codes]
        starts = np.cumsum(sizes) - sizes
        slow = np.minimum.reduceat(symbols, starts) < 0
        mark = codes == ord(SPACE)
        slow |= mark[starts] & (sizes > 1) & mark[np.minimum(starts + 1, len(mark) - 1)]
        flat, counts, odd = merge_all(np.where(symbols < 0, self.outside, symbols), sizes, self.table)
        lengths = self.sizes[np.minimum(flat, self.outside)]
        again = np.flatnonzero(slow | odd)
        if len(again):
            cuts = np.cumsum(counts)[:-1]
            ids_of, lengths_of = np.split(flat, cuts), np.split(lengths, cuts)
            for i in again.tolist():
                ids_of[i], lengths_of[i] = (np.array(x, np.int64) for x in self._slow(part[i]))
                counts[i] = len(ids_of[i])
            flat, lengths = np.concatenate(ids_of), np.concatenate(lengths_of)
        return flat.astype(np.int32), lengths.astype(np.int32), counts

    def _learn(self, chunks: list[str]) -> None:
        """Adds chunks in the order of their places."""
        found = [self._merged(chunks[at : at + CHUNKS]) for at in range(0, len(chunks), CHUNKS)]
        if not found:
            return
        self.ids, self.lengths, self.counts = (np.concatenate([old, *new]) for old, new in zip((self.ids, self.lengths, self.counts), zip(*found, strict=True), strict=True))
        self.starts = np.cumsum(self.counts) - self.counts
        self.used = np.append(self.used, np.zeros(len(chunks), np.int64))

    def _forget(self) -> None:
        """Keeps the more used half of ``MEMO`` chunks, but none of very many pieces. Use is halved, so that it fades."""
        use = np.where(self.counts > LONG, -1, self.used)
        use[0] = np.iinfo(np.int64).max
        kept = np.argsort(-use, kind="stable")[: MEMO // 2]
        kept = np.sort(kept[use[kept] >= 0])
        chunks = list(self.place)
        self.place = defaultdict(count(len(kept)).__next__, zip(map(chunks.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        starts, self.counts = self.starts[kept], self.counts[kept]
        self.ids, self.lengths = taken(self.ids, starts, self.counts), taken(self.lengths, starts, self.counts)
        self.starts, self.used = np.cumsum(self.counts) - self.counts, self.used[kept] // 2

    def chunks(self, normalised: str) -> list[str]:
        if not self.cut:
            return [normalised] if normalised else []
        if DOUBLE in normalised or "\0" in normalised:
            return self.cut.findall(normalised)
        for c in self.alone:  # without runs of marks, plain replacements find the same chunks
            normalised = normalised.replace(c, f"\0{c}\0")
        return list(filter(None, normalised.replace(SPACE, f"\0{SPACE}").split("\0")))

    def encode(self, texts: list[str | None]) -> Coded:
        if len(self.place) > MEMO or len(self.ids) > 8 * MEMO:
            self._forget()
        chunks: list[str | None] = []
        first = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            first[i] = len(chunks)
            chunks += self.chunks(self.normalizer(t or "")[0])
            chunks.append(None)
        known = len(self.place)
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        self._learn(list(islice(reversed(self.place), len(self.place) - known))[::-1])
        self.used += np.bincount(at, minlength=len(self.used))
        starts, counts = self.starts[at], self.counts[at]
        bounds = np.append(0, np.cumsum(np.add.reduceat(counts, first))) if texts else np.zeros(1, np.int64)
        return Coded(taken(self.ids, starts, counts), taken(self.lengths, starts, counts), bounds)

    def in_decimal(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The ids of each text, joined by one space."""
        parts = [self.digits[ids[a : a + SLICE]].ravel() for a in range(0, len(ids), SLICE)]
        data = b"".join([p[p > 0].tobytes() for p in parts])
        ends = np.append(0, np.cumsum(np.count_nonzero(self.digits, axis=1)[ids]))[bounds].tolist()
        return [data[a : b - 1] for a, b in zip(ends, ends[1:], strict=False)]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """What ``decode`` gives of the ids of each text."""
        sizes = self.byte_sizes[ids]
        data = b"".join([taken(self.bytes_of, self.byte_starts[ids[a : a + SLICE]], sizes[a : a + SLICE]).tobytes() for a in range(0, len(ids), SLICE)])
        ends = np.append(0, np.cumsum(sizes))[bounds].tolist()
        at = bounds.tolist()
        return [self._decoded(ids[i:j], data[a:b]) for i, j, a, b in zip(at, at[1:], ends, ends[1:], strict=False)]

    def covered(self, text: str, size: int) -> int:
        """Original bytes that the first ``size`` normalised bytes cover: pieces that tile them tile the original."""
        if not text:
            return 0
        data = text.encode()
        if self.normalizer.identity and size == 3 * self.prefix + len(data) + 2 * text.count(" "):
            return len(data)
        return int(self.spans(text, np.array([size]))[1][0])

    def spans(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, in bytes of the original text, of pieces of these lengths."""
        ends = np.cumsum(lengths.astype(np.int64))
        source = self.normalizer(text)[1]
        if source is None:
            source = self._identity_source(text)
        ends = source[ends]
        return np.append(0, ends[:-1])[: len(ends)], ends

    def _identity_source(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        width = np.where(data == 32, 3, 1)
        source = np.repeat(np.arange(len(data)), width)
        return np.concatenate([np.zeros(3 if self.prefix else 0, np.int64), source, [len(data)]])

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes put together (each bad byte a replacement character), control
        ids left out; the space mark of the first piece is the added prefix."""
        return self._decoded(ids, b"".join(map(self.piece_bytes.__getitem__, ids)))

    def _decoded(self, ids, data: bytes) -> str:
        kind, first = self.kind, 0
        while first < len(ids) and kind[ids[first]] == CONTROL:
            first += 1
        if first < len(ids) and (self.prefix or self.squeeze) and self.text[ids[first]].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._mend(ids)

    def _mend(self, ids: list[int]) -> str:
        out, run, first = [], bytearray(), True

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.kind[i] == BYTE:
                run += self.piece_bytes[i]
                first = False
                continue
            flush()
            piece = self.piece_bytes[i].decode()
            if first and self.kind[i] != CONTROL:
                first = False
                if self.text[i].startswith(SPACE) and (self.prefix or self.squeeze):
                    piece = piece[1:]
            out.append(piece)
        flush()
        return "".join(out)


def encoder(path: str) -> Encoder:
    return memo(f"pieces of {path}", lambda: Encoder(path))


def _some(texts: list, most: int = 1 << 20) -> Iterator[list]:
    """Consecutive texts of about so many code points together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True, spans: bool = False) -> DataFrame:
    """id_col, ids (with the end id) and round_trip (whether they decode to the text) of every
    row; if asked for, decoded, and starts and ends, the original bytes of every piece (the end
    id covers none)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "ids", "round_trip", *["decoded"] * decoded, *["starts", "ends"] * spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            at = 0
            for texts in _some(batch.column(1).to_pylist()):
                ids, lengths, bounds = enc.encode(texts)
                back = enc.decode_all(ids, bounds)
                same = [x == (t or "") for x, t in zip(back, texts, strict=True)]
                offsets = pa.array(bounds, pa.int32())
                cols = [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(same, pa.bool_())]
                if decoded:
                    cols.append(pa.array(back, pa.string()))
                if spans:
                    both = [enc.spans(t or "", lengths[a:b]) for t, a, b in zip(texts, bounds, bounds[1:], strict=False)]
                    cols += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in both]), pa.int64())) for k in (0, 1)]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"id {kind}, ids array<int>, round_trip boolean" + ", decoded string" * decoded + (", starts array<long>, ends array<long>" if spans else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 and span_bytes (original bytes that the
    pieces cover, the whole text); what is encoded and decoded doesn't leave the worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            at = 0
            for texts in _some(batch.column(1).to_pylist()):
                ids, lengths, bounds = enc.encode(texts)
                coded_as = [hashlib.sha256(x).hexdigest() for x in enc.in_decimal(ids, bounds)]
                decoded_as = [hashlib.sha256(x.encode()).hexdigest() for x in enc.decode_all(ids, bounds)]
                covered = list(map(enc.covered, texts, np.add.reduceat(lengths, bounds[:-1], dtype=np.int64).tolist()))
                ids_col = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids_col, pa.array(np.diff(bounds), pa.int64()), pa.array(coded_as), pa.array(decoded_as), pa.array(covered, pa.int64())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"],
                )

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
