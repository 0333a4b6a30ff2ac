"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked as the library does (spaces become U+2581, one in front) and cut into marked words, across which no piece
reaches. The distinct words of a batch are sorted and walked depth-first as the trie they form: the forward table of a word
is kept up to the prefix it shares with the next, so each trie node is computed once. A node's forward entry is the best
piece that ends there, with its score and the node it starts from.

For a unigram model any piece may follow any other, and the table is plain Viterbi. For a merge (BPE) model a piece may follow
another only if merging the text of the two gives back just these two: a segmentation is what the merges produce if and only if
each of its neighbours passes that test, so one piece is admissible at each node and the same table gives the library's ids.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hirelens.llm.common import documents
from hirelens.llm.packing import slices

SPACE = "▁"
CACHE = 150_000  # words a worker remembers, in each of two generations
PAIRS = 300_000  # tested neighbours a worker remembers
NONE = -1  # in place of a piece: the start of a word, or a character without a piece, which joins nothing
_models: dict = {}


class PieceModel:
    """Pieces, scores and byte pieces of a model file. `kind`: "bpe" or "unigram", as the model was made."""

    def __init__(self, path: str, kind: str = "bpe") -> None:
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        size, inner = self.inner.get_piece_size(), self.inner
        plain = [i for i in range(size) if not (inner.is_control(i) or inner.is_unknown(i) or inner.is_byte(i) or inner.is_unused(i))]
        self._set({inner.id_to_piece(i): (i, inner.get_score(i)) for i in plain}, kind)
        self.text = [inner.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(inner.id_to_piece(i)[1:-1], 16): i for i in range(size) if inner.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.unknown = inner.unk_id()

    def _set(self, pieces: dict[str, tuple[int, float]], kind: str) -> None:
        self.pieces, self.kind = pieces, kind
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            lengths.setdefault(p[-2:], set()).add(len(p))
        # lengths of the pieces with given last two characters, longest first; one character may always be a piece
        self.lengths = {end: (*sorted(found, reverse=True), 1) for end, found in lengths.items() if len(end) == 2}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.spelled = {i: p for p, (i, _) in pieces.items()}
        # characters no piece has never join anything: texts are cut around the common ones of them, line ends
        loose = "".join(c for c in "\n\r\t" if not any(c in p for p in pieces))
        self.word = re.compile(f"[{re.escape(loose)}]|{SPACE}*[^{SPACE}{re.escape(loose)}]+|{SPACE}+" if loose else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """Pieces by the merge rule: of the neighbours that join to a piece the best scored, the leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = self.pieces.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether piece `right` may stand after piece `left`, or after NONE."""
        if self.kind == "unigram":
            return True
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            both = [self.spelled[right]] if left == NONE else [self.spelled[left], self.spelled[right]]
            found = self.pairs[key] = self.merged("".join(both)) == both
        return found

    def encode_words(self, words: list[str]) -> None:
        """Encode distinct words in sorted order, reusing the forward table of the prefix shared with the word before."""
        pieces, lengths, pairs, may_follow = self.pieces, self.lengths, self.pairs, self.may_follow
        single = (1,)
        only_one = self.kind != "unigram"  # at most one piece is admissible at a node
        last, score, start = [NONE], [0.0], [0]  # forward table by depth
        before = ""
        for word in sorted(words):
            depth = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :], score[depth + 1 :], start[depth + 1 :]
            for i in range(depth + 1, len(word) + 1):
                top, piece, begin = -float("inf"), NONE, i - 1
                for n in lengths.get(word[i - 2 : i], single) if i > 1 else single:
                    if n > i:
                        continue
                    j = i - n
                    found = pieces.get(word[j:i])
                    if found is None:
                        continue
                    there, total = found[0], score[j] + found[1]
                    if total > top:
                        ok = pairs.get(last[j] << 32 | there)
                        if ok or ok is None and may_follow(last[j], there):
                            top, piece, begin = total, there, j
                            if only_one:
                                break
                if piece == NONE:  # a character without a piece: bytes
                    top = score[i - 1]
                last.append(piece), score.append(top), start.append(begin)
            before = word
            ids, i = [], len(word)
            while i > 0:
                if last[i] != NONE:
                    ids.append(last[i])
                elif self.byte_ids:
                    ids.extend(self.byte_ids[b] for b in reversed(word[i - 1].encode("utf-8", "surrogatepass")))
                else:
                    ids.append(self.unknown)
                i = start[i]
            ids.reverse()
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; the empty text has none."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        parts = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known, older = self.known, self.older
        fresh = {w for p in parts for w in p if w not in known}
        if older:
            known.update((w, older[w]) for w in fresh if w in older)
            fresh = [w for w in fresh if w not in known]
        self.encode_words(list(fresh))
        return [b"".join([known[w] for w in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of the ids: one leading space goes, byte pieces become the characters they spell (or U+FFFD)."""
        raw, bytes_of, text = bytearray(), self.bytes, self.text
        for i in np.frombuffer(ids, "<u4").tolist():
            b = bytes_of.get(i)
            if b is None:
                raw += text[i].encode()
            else:
                raw.append(b)
        out = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if out.startswith(" ") else out


def model(path: str, kind: str = "bpe") -> PieceModel:
    """One per Python worker, file and kind."""
    if (path, kind) not in _models:
        _models[path, kind] = PieceModel(path, kind)
    return _models[path, kind]


def _encode(path: str, kind: str):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = model(path, kind).encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids): four bytes an id. One row per row of `docs`; NULL or empty text has no ids. An empty table gives no rows."""
    return documents(docs).mapInArrow(_encode(path, kind), "doc_id long, ids binary")


def _decode(path: str, kind: str):
    def run(batches):
        for batch in batches:
            texts = [model(path, kind).decode(x or b"").encode("utf-8", "replace").decode() for x in batch.column("ids").to_pylist()]
            crc = pa.array([zlib.crc32(x or b"") for x in batch.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "ids")), pa.array(texts, pa.string()), crc], names=["doc_id", "ids", "text", "ids_crc32"])

    return run


def decode(encoded: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids, text, ids_crc32) of (doc_id, ids). Where the encoded text had U+2581 itself, a space comes back, as in the library."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path, kind), "doc_id long, ids binary, text string, ids_crc32 long")


def _round_trip(path: str, kind: str):
    def run(batches):
        own = model(path, kind)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = own.encode_batch(texts[a:b])
                back = [own.decode(x).encode("utf-8", "replace").decode() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(back, pa.string())],
                    names=["doc_id", "n_tokens", "ids_crc32", "text"])

    return run


def round_trip(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text): `encode` and `decode` in one pass, so that a task needs one Python worker, not two."""
    return documents(docs).mapInArrow(_round_trip(path, kind), "doc_id long, n_tokens long, ids_crc32 long, text string")
