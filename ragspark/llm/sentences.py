"""SentencePiece encoding and decoding as shortest paths in a weighted transducer.

The transducer is the composition of the normaliser (white space escaped, a dummy space in front), the pieces, and the
byte fallback. Composed with an input it is a lattice over the input's positions: an arc for each piece that fits, and for a
character that no piece covers an arc that writes its bytes, dearer than any piece. The path of least weight in the
tropical semiring is the encoding. A unigram model weighs a piece by its negative score. A merge model (BPE) takes a path
only if any two neighbouring pieces are what merging would make of their text; a text has exactly one such path, and its
prefixes have one as well, so the search keeps a single state per position.

Pieces never reach from other characters into white space, so a text is composed a word at a time, each distinct one once
per worker process.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragspark.llm import tokens
from ragspark.llm import words as T

SPACE = "▁"
UNIGRAM, MERGE = 1, 2
_FALLBACK = 1e6


class Transducer:
    def __init__(self, path):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rule = spec.normalizer_spec
        if rule.precompiled_charsmap or not rule.escape_whitespaces or rule.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser and escaped white space in front are compiled")
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.dummy = spec.trainer_spec.model_type, rule.add_dummy_prefix
        self.pieces, self.scores, self.byte, self.unknown = {}, {}, [None] * 256, library.unk_id()
        self.written = []
        for i in range(library.vocab_size()):
            text = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                self.written.append(bytes([int(text[3:5], 16)]))
            elif library.is_unknown(i):
                self.written.append(" ⁇ ".encode())
            elif library.is_control(i) or library.is_unused(i):
                self.written.append(b"")
            else:
                self.pieces[text], self.scores[text] = i, library.get_score(i)
                self.written.append(text.replace(SPACE, " ").encode())
        self.root = {}
        for text in self.pieces:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = text
        self.fits = {}

    def merged(self, text):
        """What merging makes of a text: the neighbours with the best score first, the leftmost of them."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last, piece):
        key = (last, piece)
        ok = self.fits.get(key)
        if ok is None:
            ok = self.fits[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return ok

    def path(self, text):
        """Pieces and uncovered characters of the path of least weight."""
        n, merge = len(text), self.kind == MERGE
        weight, back = [None] * (n + 1), [None] * (n + 1)
        weight[0], back[0] = 0.0, ""
        if len(self.fits) > 300_000:
            self.fits.clear()
        for i in range(n):
            if weight[i] is None:
                continue
            node, k, single = self.root, i, False
            while k < n:
                node = node.get(text[k])
                if node is None:
                    break
                k += 1
                piece = node.get("")
                if piece is None:
                    continue
                single |= k == i + 1
                if merge and not self.follows(back[i], piece):
                    continue
                w = weight[i] - (0.0 if merge else self.scores[piece])
                if weight[k] is None or w < weight[k]:
                    weight[k], back[k] = w, piece
            if not single and (not merge or self.follows(back[i], text[i])):
                w = weight[i] + _FALLBACK
                if weight[i + 1] is None or w < weight[i + 1]:
                    weight[i + 1], back[i + 1] = w, text[i]
        out, k = [], n
        while k:
            out.append(back[k])
            k -= len(back[k])
        return out[::-1]

    def ids(self, text):
        out = []
        for piece in self.path(text.replace(" ", SPACE)):
            i = self.pieces.get(piece)
            out += [i] if i is not None else [self.unknown if self.byte[b] is None else self.byte[b] for b in piece.encode()]
        return out


_LINE_END = 10


class PieceEncoder(tokens.UnitEncoder):
    def __init__(self, path):
        self.transducer = Transducer(path)
        self.plain_line_end = not any("\n" in p for p in self.transducer.pieces)
        self.written = [np.frombuffer(b, np.uint8) for b in self.transducer.written]
        self.width = np.array([len(b) for b in self.written], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.bytes = np.concatenate(self.written)
        self._forget()

    def units(self, texts):
        return [self.transducer.ids(t) for t in texts]

    def starts(self, data, offsets):
        """A unit starts at a space after what is surely no space, and before and after a line end that no piece holds."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = tokens._CLASS[data]
        visible = (kind == 2) | (kind == 4) | (kind == 16)
        visible[1:] |= (kind[:-1] == 8) & (data[1:] >= 0x80)
        start = np.zeros(n, bool)
        start[1:] = visible[:-1] & (data[1:] == 32)
        if self.plain_line_end:
            line = data == _LINE_END
            start |= line
            start[1:] |= line[:-1]
        edge = offsets[:-1]
        start[edge[edge < n]] = True
        return np.flatnonzero(start)

    def encode_rows(self, data, offsets):
        """Ids and row offsets; a row that is not empty gets the dummy space in front."""
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if self.transducer.dummy and len(filled):
            more = np.zeros(len(offsets), np.int64)
            more[filled + 1] = 1
            data, offsets = np.insert(data, offsets[filled], 32), offsets + np.cumsum(more)
        return self.encode(data, offsets)

    def decode_rows(self, ids, rows):
        """Bytes of all rows one after another and their offsets, without the dummy space."""
        width = self.width[ids]
        edge = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(width, out=edge[1:])
        out = self.bytes[np.repeat(self.place[ids] - edge[:-1], width) + np.arange(edge[-1])]
        offsets = edge[rows]
        if self.transducer.dummy and len(out):
            first = offsets[:-1][np.diff(offsets) > 0]
            first = first[out[first] == 32]
            out, offsets = np.delete(out, first), offsets - np.searchsorted(first, offsets)
        return out, offsets


_encoders = {}


def encoder(path):
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode(docs, path, doc_id="doc_id", text="text"):
    """Per row doc_id and its ids as array<int>. Null and empty texts have none; repeated rows are encoded each."""
    def run(batches):
        for b in batches:
            for first, data, offsets in T.slices(b.column(1)):
                ids, rows = encoder(path).encode_rows(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(lists)), lists], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows, path):
    """Per row of (doc_id, ids) its text; unknown ids outside the vocabulary are an error, no ids give the empty text."""
    def run(batches):
        for b in batches:
            column = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
            n = np.fromiter((len(v) if v is not None else 0 for v in column), np.int64, len(column))
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out, offsets = encoder(path).decode_rows(ids, np.concatenate(([0], np.cumsum(n))))
            raw = out.tobytes()
            text = [raw[a:z].decode("utf-8", "replace") for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text)], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs, path, doc_id="doc_id", text="text"):
    """Per row doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), n_bytes of the decoded text, and
    whether that is the text, with the escape character itself read as a space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_bytes", pa.int64()), ("same", pa.bool_())])
    mark = SPACE.encode()

    def run(batches):
        for b in batches:
            for first, data, offsets in T.slices(b.column(1)):
                own = encoder(path)
                ids, rows = own.encode_rows(data, offsets)
                out, edge = own.decode_rows(ids, rows)
                raw, packed, source = out.tobytes(), memoryview(ids.astype("<u4").tobytes()), data.tobytes()
                crc = [zlib.crc32(packed[4 * a : 4 * z]) for a, z in zip(rows[:-1].tolist(), rows[1:].tolist())]
                same = [raw[a:z] == source[p:q].replace(mark, b" ") for a, z, p, q in zip(edge[:-1].tolist(), edge[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(same)), pa.array(np.diff(rows)), pa.array(crc, pa.int64()), pa.array(np.diff(edge)), pa.array(same)], schema=schema
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, same boolean")
