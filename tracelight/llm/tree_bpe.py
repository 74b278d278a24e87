"""Byte-level BPE by monoid tree reduction.

A text is cut in halves down to leaves of at most LEAF characters; a leaf is split by the tokenizer's pattern. Joining two
neighbours re-splits a window around the seam: it opens at the last left piece whose start cannot depend on what follows
the seam, and grows to the right until the fresh pieces meet a piece start of the right part. The splitter reads from left
to right and keeps no state between pieces, so all pieces outside the window stand. Within one long piece the same is done
on bytes: halves are encoded recursively and the tokens around the seam are re-encoded in a growing window until the
window's first and last token are each compatible with the neighbour outside it (their two-token text encodes to just
these two tokens). A token sequence is the encoding exactly if all adjacent pairs are compatible, so tokens outside the
window are then final.

Decoding concatenates the tokens' bytes up a tree of the same shape.

Defined results: null and empty texts have no tokens; any text, of any length, is handled whole; special tokens' strings
are ordinary text. Null doc_id: kept as null. Repeated rows and equal ids each get their row; rows do not meet, so there
are no ties. Empty table: empty result. Only doc_id and text are read, so other columns may have any names. The file of
ranks is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 1024  # characters of a text leaf, tokens of a decoding leaf
SHORT = 64  # bytes of a piece leaf
CACHED = 200_000  # pieces of a generation that a worker remembers


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> "Codec":
    return Codec(path, pattern)


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.token = {v: k for k, v in self.rank.items()}
        self.split = regex.compile(pattern)
        self.known: dict[str, tuple[str, int]] = {}
        self.older: dict[str, tuple[str, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # --- one piece ---

    def _merge(self, piece: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        rank = self.rank
        if (whole := rank.get(piece)) is not None:
            return [whole]
        parts, get, far = [piece[i : i + 1] for i in range(len(piece))], rank.get, 1 << 60
        ranks = [get(piece[i : i + 2], far) for i in range(len(piece) - 1)]
        while ranks and (low := min(ranks)) != far:
            i = ranks.index(low)
            made = parts[i] + parts.pop(i + 1)
            parts[i] = made
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(made + parts[i + 1], far)
            if i:
                ranks[i - 1] = get(parts[i - 1] + made, far)
        return [rank[p] for p in parts]

    def _compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHED:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self._compatible(left[-1], right[0]):
            return left + right
        token = self.token
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = b"".join(token[t] for t in left[-i:] + right[:j])
            middle = self._merge(window) if len(window) <= 4 * SHORT else self._halves(window)
            good_left = i == len(left) or self._compatible(left[-i - 1], middle[0])
            good_right = j == len(right) or self._compatible(middle[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - i] + middle + right[j:]
            i, j = i if good_left else 2 * i, j if good_right else 2 * j

    def _halves(self, piece: bytes) -> list[int]:
        if len(piece) <= SHORT:
            return self._merge(piece)
        half = len(piece) // 2
        return self._join(self._halves(piece[:half]), self._halves(piece[half:]))

    def piece(self, piece: str) -> list[int]:
        return self._halves(piece.encode("utf-8", "surrogatepass"))

    # --- one text ---

    def _seam(self, text: str, left: list[str], right: list[str], cut: int, end: int) -> list[str]:
        """The pieces of left and right, which meet at cut, with those around the seam split afresh."""
        at, keep = cut, len(left)
        # A piece's end was settled by characters up to one past it, or four from its start: all must lie left of the cut.
        while keep and not (at + 2 <= cut and at - len(left[keep - 1]) + 4 <= cut):
            keep -= 1
            at -= len(left[keep])
        fresh, match, n, start = left[:keep], self.split.match, 0, cut
        while at < end:
            while n < len(right) and start < at:
                start += len(right[n])
                n += 1
            if start == at:
                return fresh + right[n:]
            m = match(text, at, end)
            fresh.append(m.group())
            at = m.end()
        return fresh

    def _pieces(self, text: str, start: int, end: int) -> list[str]:
        if end - start <= LEAF:
            return self.split.findall(text, start, end)
        cut = (start + end) // 2
        return self._seam(text, self._pieces(text, start, cut), self._pieces(text, cut, end), cut, end)

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches over the whole text, by halves."""
        return self._pieces(text, 0, len(text))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(text):
            out.extend(self.piece(p))
        return out

    def _told(self, p: str) -> tuple[str, int]:
        """A piece's ids as text and their number. What was asked for of the last 2 x CACHED pieces is remembered."""
        found = self.older.get(p)
        if found is None:
            ids = self.piece(p)
            found = " ".join(map(str, ids)), len(ids)
        if len(p) <= SHORT:
            if len(self.known) >= CACHED:
                self.older, self.known = self.known, {}
            self.known[p] = found
        return found

    def encoded(self, text: str) -> tuple[str, int]:
        """The decimal ids joined by a space, and their number."""
        words, n = [], 0
        for p in self.pieces(text):
            found = self.known.get(p) or self._told(p)
            words.append(found[0])
            n += found[1]
        return " ".join(words), n

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up a tree of halves."""
        if len(ids) <= LEAF:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return b"".join((self.decode(ids[:half]), self.decode(ids[half:])))


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the token ids themselves if asked for."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                counts, sums, decoded, tokens = [], [], [], []
                for text in part.column("text"):
                    line, n = c.encoded(text.as_py() or "")
                    got = list(map(int, line.split()))
                    counts.append(n)
                    sums.append(hashlib.sha256(line.encode()).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(got)).hexdigest())
                    if ids:
                        tokens.append(got)
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns, names = [*columns, pa.array(tokens, pa.list_(pa.int32()))], [*names, "token_ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
