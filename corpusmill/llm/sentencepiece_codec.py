"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reads a text once. At each position its output links give every piece that ends there,
and each relaxes the best score of that position from the one where the piece begins. A character that no piece
covers falls back to its bytes.

Scores. A unigram model's pieces have theirs, and the best sum wins. In a model of merges (BPE) the plain sum is not
what the library gives, so the scores are made from the order of merges: the pieces found in a stretch of text are
ranked by when their merge takes place (the model's score, then the place), each rank counts more than all later ones
together (a power of two), and a piece counts its own rank and those of the merges within it. As a piece is merged later
than its parts, the best sum is the outcome of merging. Two kinds of stretch go another way, which gives the same ids:
those beyond `wide` characters, where such a score would have too many bits, and those with a piece that the model does
not rank after its parts (runs of spaces). There the model's scores are relaxed over the pieces that merges leave
apart from the one before.

A text is cut where no piece holds both neighbours; the stretches are encoded once each and kept in a bounded memory.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"  #: U+2581, how pieces write a space
_UNIGRAM, _BPE = 1, 2
_KEPT = 64  #: characters of the longest stretch that is kept in memory


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; fixed32 values as bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encoder and decoder of a model file, by name or path. `most` bounds the stretches and pairs kept in memory."""

    def __init__(self, model: str = "piece_bpe_32k.model", most: int = 600_000, wide: int = 512):  # below 1024, which a find's number has room for
        if "/" not in model:
            import public_tokenizers

            model = public_tokenizers.path(model)
        with open(model, "rb") as f:
            parts = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in parts if k == 2), b"")))
        normal = dict(_fields(next((v for k, v in parts if k == 3), b"")))
        if normal.get(2):
            raise ValueError("models with a character map are not supported")
        self.kind = trainer.get(3, _UNIGRAM)
        self.dummy_prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.most, self.wide, self.known, self.pairs = most, wide, {}, {}
        self.text, self.score, self.byte_id, self.usable, self.unk = [], [], {}, {}, 0
        for i, raw in enumerate(v for k, v in parts if k == 1):
            piece = dict(_fields(raw))
            text, kind = piece.get(1, b"").decode(), piece.get(3, 1)
            self.text.append(text)
            self.score.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
            if kind == 6:
                self.byte_id[int(text[1:-1], 16)] = i
            elif kind == 2:
                self.unk = i
            elif kind in (1, 4):
                self.usable[text] = i
        self.bytes_of = {i: b for b, i in self.byte_id.items()}
        self.silent = set(range(len(self.text))) - set(self.usable.values()) - {self.unk}
        self.special = self.silent | set(self.bytes_of)
        self.floor = min((self.score[i] for i in self.usable.values()), default=0.0) - 10
        self.machine = ahocorasick.Automaton()
        for text, i in self.usable.items():  # a node's own piece comes before those of its output links, the longest first
            self.machine.add_word(text, (len(text), i))
        self.machine.make_automaton()
        if self.kind == _BPE:
            self._order_merges()
        # characters by number, 0 for those of no piece; and which pairs of them some piece holds as neighbours
        chars = sorted({c for t in self.usable for c in t})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        held = {t[k : k + 2] for t in self.usable for k in range(len(t) - 1)}
        self.joined[[self.number[ord(p[0])] for p in held], [self.number[ord(p[1])] for p in held]] = True

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(t for t in text.split(" ") if t)
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE)

    def _merged(self, text: str) -> tuple[list[str], int]:
        """What merging leaves of a short text (the best-scored neighbours first, the leftmost of equals), and the length of the
        last merge's left part."""
        parts, left = list(text), 0
        while len(parts) > 1:
            at = [(self.score[i], -k) for k in range(len(parts) - 1) if (i := self.usable.get(parts[k] + parts[k + 1])) is not None]
            if not at:
                break
            k = -max(at)[1]
            left = len(parts[k])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, left

    def _order_merges(self) -> None:
        """Ranks the pieces by when merges make them, and builds the automaton whose values hold rank, begin and end.

        A find of a piece is one number, rank << 20 | begin << 10 | end; `to_left` and `to_right` lead from its place to those of
        the parts it is merged from. Ranks from `unordered` on have pieces that are not merged later than their parts.
        """
        rows, never = [], set()
        for text, i in self.usable.items():
            if len(text) > 1:
                parts, k = self._merged(text)
                late = len(parts) == 1 and all(len(x) == 1 or self.score[self.usable[x]] > self.score[i] for x in (text[:k], text[k:]))
                if len(parts) == 1:
                    rows.append((not late, -self.score[i], i, len(text), k))
                else:
                    never.add(i)
        rows.sort()
        self.unordered = sum(not r[0] for r in rows) << 20
        self.of_rank, self.to_left, self.to_right = [r[2] for r in rows], [r[3] - r[4] for r in rows], [r[4] << 10 for r in rows]
        self.merges = ahocorasick.Automaton()
        for rank, (_, _, i, length, _) in enumerate(rows):
            self.merges.add_word(self.text[i], (rank << 20) - (length - 1 << 10) + 1)
        if rows:
            self.merges.make_automaton()
        self.never = never

    def _apart(self, a: int, b: int) -> bool:
        """Whether merges leave the pieces a and b apart when they meet."""
        if len(self.pairs) > self.most:
            self.pairs.clear()
        known = self.pairs[a * len(self.text) + b] = self._merged(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]
        return known

    def viterbi(self, text: str) -> list[int]:
        """Ids of a normalised text, the best sum of scores over all segmentations."""
        if self.kind == _BPE and self.of_rank and len(text) <= self.wide:
            ids = self._by_merge_order(text)
            if ids is not None:
                return ids
        return self._by_model_scores(text)

    def _alone(self, char: str) -> list[int]:
        """A character's own piece, or its bytes, the last first."""
        i = self.usable.get(char)
        return [i] if i is not None else [self.byte_id.get(x, self.unk) for x in reversed(char.encode())] if self.byte_id else [self.unk]

    def _by_merge_order(self, text: str) -> list[int] | None:
        """The best sum where scores are merge orders; None if a piece is found that has none."""
        found = [v + end * 1025 for end, v in self.merges.iter(text)]
        n, bit, value, come = len(text), 1 << len(found), {}, {}
        score, to_left, to_right = value.get, self.to_left, self.to_right
        ranked = sorted(found)
        if found and ranked[-1] >= self.unordered:
            return None
        for e in ranked:  # parts come before what is merged from them
            bit >>= 1
            rank, place = e >> 20, e & 0xFFFFF
            value[place] = bit + score(place - to_left[rank], 0) + score(place + to_right[rank], 0)
        best, done = [0] * (n + 1), 0
        for e in found:
            place = e & 0xFFFFF
            end = place & 1023
            while done < end:
                done += 1
                best[done] = best[done - 1]
            total = best[place >> 10] + value[place]
            if total > best[end]:
                best[end], come[end] = total, e
        out: list[int] = []
        while n:
            e = come.get(n)
            if e is None:
                n -= 1
                out += self._alone(text[n])
            else:
                out.append(self.of_rank[e >> 20])
                n = e >> 10 & 1023
        return out[::-1]

    def _by_model_scores(self, text: str) -> list[int]:
        """The best sum of the model's own scores; for a model of merges over pieces that merges leave apart."""
        n, low, merges, many, score, pairs = len(text), -np.inf, self.kind == _BPE, len(self.text), self.score, self.pairs
        best, last, size = [low] * (n + 1), [-1] * (n + 1), [1] * (n + 1)
        best[0], done = 0.0, 0
        for end, (length, i) in self.machine.iter(text):  # the longest of the pieces that end here comes first
            while done < end:
                done += 1
                if best[done] == low:  # no piece ends here: the character alone, by its bytes
                    best[done] = best[done - 1] + self.floor
            end += 1
            begin = end - length
            value = best[begin] + score[i]
            if value > best[end]:
                if merges and (before := last[begin]) >= 0:
                    apart = pairs.get(before * many + i)
                    if not (self._apart(before, i) if apart is None else apart):
                        continue
                if merges and i in self.never:
                    continue
                best[end], last[end], size[end] = value, i, length
        out: list[int] = []
        while n:
            out += [last[n]] if last[n] >= 0 else self._alone(text[n - 1])
            n -= size[n]
        return out[::-1]

    def stretches(self, text: str) -> list[str]:
        """A normalised text cut wherever no piece holds both neighbours."""
        c = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = (np.flatnonzero(~self.joined[c[:-1], c[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def encoded(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        text = self.normalize(text)
        if not text:
            return b""
        parts, known = self.stretches(text), self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            long: dict[str, bytes] = {}
            for p in set(parts).difference(known):
                (known if len(p) <= _KEPT else long)[p] = _packed(self.viterbi(p))
            return b"".join([long[p] if len(p) > _KEPT else known[p] for p in parts] if long else map(known.__getitem__, parts))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: runs of byte pieces as UTF-8 (bad bytes replaced), and without the space put in front."""
        ids = [i for i in ids if i is not None and 0 <= i < len(self.text)]
        if self.special.isdisjoint(ids):
            return self._plain("".join(map(self.text.__getitem__, ids)))
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            if i in self.silent:
                continue
            out.append(self.text[i])
        return self._plain("".join(out) + run.decode(errors="replace"))

    def _plain(self, text: str) -> str:
        text = text.replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec_of(model: str) -> Codec:
    """One codec for all tasks of a worker process."""
    return Codec(model)


_FIELDS = "n_tokens long, n_byte_tokens long, ids_crc32 long, restored boolean"


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", with_ids: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_tokens, n_byte_tokens, ids_crc32, restored; with_ids adds ids array<int>.

    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers. restored: decoding the ids gives the text
    back (it can't where a text holds U+2581 itself, which decodes to a space). Null text is encoded as empty: no ids. Repeated rows stay,
    null ids pass through, other columns are not read. An empty table gives no rows. No shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in batches:
            rows, kept = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                raw = codec.encoded(text)
                ids = np.frombuffer(raw, "<u4").tolist()
                rows.append((len(ids), 0 if codec.special.isdisjoint(ids) else sum(map(codec.bytes_of.__contains__, ids)), zlib.crc32(raw), codec.decode(ids) == text))
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            columns = list(zip(*rows)) if rows else [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays] + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "restored"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FIELDS}{', ids array<int>' * with_ids}")


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids array<int>, ...) -> doc_id, text, a row for each row.

    Null and empty ids decode to the empty text, null and unknown ids within them to nothing. Repeated rows stay, null
    doc_ids pass through, other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(i.as_py() or ()) for i in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
