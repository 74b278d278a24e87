"""Personal data in texts: fixed patterns, and a character BiLSTM-CRF that adds spans of looser forms.

The base spans (email, ip, card, phone) come from linear scans of the whole text and always stay. The tagger decodes every
window of SIZE characters, each SIZE - STRIDE into the next, by Viterbi. Windows are reconciled over the whole text: of two
windows over a character the one in which it stands further inside decides, so a span of up to (SIZE - STRIDE) / 2
characters lies whole in some window that decides it; the tags are joined to one sequence and read as spans. A tagger span
that overlaps a base span gives way to it, one that lies within a match which a base rule rejected (length, Luhn, parts
above 255) is dropped for that kind, and one without the digits or marks of its kind is dropped.

Training: labelled spans set into pieces of BACKGROUNDS texts (those of the smallest hashes of doc_id; a stretch of STRETCH
characters of each, from a hashed position), on the driver, once for each set of parameters.

Defined results. Null text: empty, no spans. Positions are code points, end exclusive. Null doc_id: kept as null. Repeated
rows and equal texts each get their row. Very long texts are handled whole. Empty table: empty result. Only doc_id and text
are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.char_crf import KINDS, Tagger, codes, trained
from tracelight.llm.kit import fewest

SIZE, STRIDE, BATCH, SPACE = 512, 416, 1024, codes(" ")[0]
#: Characters of texts that a task takes at once, in whole texts.
TOGETHER = 1 << 21
BACKGROUNDS, STRETCH, TRAINED, WINDOWS, HIDDEN, EPOCHS = 64, 2000, 96, 3000, 12, 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PLUS_DIGIT = re.compile(r"\+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a match starts where the run of local characters before an '@' does, or the last match ends."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            low = m.end()
        else:
            low = max(low, start)
        at = text.find("@", max(at + 1, low))
    return out


def base_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Spans of each kind that pass, and the matches of each kind that fail their check."""
    good: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    bad: list[list[tuple[int, int]]] = [[], [], [], []]
    for m in _IP.finditer(text):
        (good if all(len(p.lstrip("0")) <= 3 and int(p[-6:]) <= 255 for p in m.group().split(".")) else bad)[1].append(m.span())
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        (good if 13 <= len(d) <= 19 and luhn(d) else bad)[2].append(m.span())
    if _PLUS_DIGIT.search(text):
        for m in _PHONE.finditer(text):
            (good if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15 else bad)[3].append(m.span())
    return good, bad


def _plausible(kind: int, span: str) -> bool:
    n = sum("0" <= c <= "9" for c in span)
    if kind == 0:
        return "@" in span and len(span) >= 6
    if kind == 1:
        return 4 <= n <= 12 and span.count(".") >= 3
    if kind == 2:
        return 13 <= n <= 19 and luhn("".join(c for c in span if "0" <= c <= "9"))
    return 9 <= n <= 15


def window_starts(length: int, size: int, stride: int) -> np.ndarray:
    """Starts of the windows that cover a text; none for an empty one."""
    return np.arange(0, max(1, length - size + stride), stride) if length else np.zeros(0, np.int64)


def reconcile(length: int, starts: np.ndarray, paths: np.ndarray, size: int, stride: int) -> np.ndarray:
    """One tag a character from overlapping windows: the window decides in which it stands further inside."""
    tags, margin = np.zeros(length, np.int8), (size - stride) // 2
    for s, p in zip(starts.tolist(), paths):
        a = s + margin if s else 0
        b = min(length, s + size - margin if s + size < length else length)
        tags[a:b] = p[a - s : b - s]
    return tags


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of each run of one kind; a begin tag opens a new span."""
    kind = (tags.astype(np.int64) + 1) // 2
    cut = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1), [True]]))
    return [(int(kind[a]) - 1, int(a), int(b)) for a, b in zip(cut[:-1], cut[1:]) if kind[a]]


def decoded(tagger: Tagger, pieces: list[np.ndarray]) -> list[np.ndarray]:
    """A path for each window, BATCH windows of like length at once; shorter ones are filled with spaces."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(pieces)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    for lo in range(0, len(order), BATCH):
        some = order[lo : lo + BATCH]
        block = np.full((len(some), len(pieces[some[-1]])), SPACE, np.uint8)
        for r, i in enumerate(some):
            block[r, : len(pieces[i])] = pieces[i]
        for i, path in zip(some, tagger.decode(block)):
            out[i] = path
    return out


def found(texts: list[str], tagger: Tagger, size: int = SIZE, stride: int = STRIDE) -> list[tuple[list, list]]:
    """For each text the base spans by kind and the tagger's further spans (kind, start, end). All windows are decoded."""
    base = [base_spans(text) for text in texts]
    work = [(x, window_starts(len(x), size, stride)) for x in map(codes, texts)]
    paths = decoded(tagger, [x[s : s + size] for x, starts in work for s in starts.tolist()])
    more: list[list] = [[] for _ in texts]
    at = 0
    for i, (x, starts) in enumerate(work):
        tags = reconcile(len(x), starts, paths[at : at + len(starts)], size, stride)
        at += len(starts)
        if not tags.any():
            continue
        good, bad = base[i]
        taken, judged = np.zeros(len(x), bool), np.zeros((len(KINDS), len(x)), np.int64)
        for kind in range(len(KINDS)):
            for a, b in good[kind]:
                taken[a:b] = True
            for a, b in bad[kind]:
                judged[kind, a:b] = b
        for kind, a, b in tag_spans(tags):
            piece = texts[i][a:b]
            a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
            if _plausible(kind, texts[i][a:b]) and judged[kind, a] < b and not taken[a:b].any():
                more[i].append((kind, a, b))
                taken[a:b] = True
    return [(good, extra) for (good, _), extra in zip(base, more)]


def together(batch: pa.RecordBatch, chars: int = TOGETHER) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), about `chars` characters each, so that windows of like length meet."""
    lo, texts, n = 0, [], 0
    for i, value in enumerate(batch.column("text")):
        texts.append(value.as_py() or "")
        n += len(texts[-1])
        if n >= chars or i + 1 == len(batch):
            yield batch.slice(lo, len(texts)), texts
            lo, texts, n = i + 1, [], 0


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit(docs: DataFrame, backgrounds: int = BACKGROUNDS, stretch: int = STRETCH, windows: int = WINDOWS, hidden: int = HIDDEN, epochs: int = EPOCHS, size: int = TRAINED) -> Tagger:
    """The tagger trained on `windows` generated windows over a stretch of each of `backgrounds` texts, drawn by hash."""
    at = 1 + F.pmod(F.xxhash64(F.lit("at"), "doc_id"), F.greatest(F.lit(1), F.char_length("text") - stretch + 1)).cast("int")
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", F.substring("text", at, F.lit(stretch)).alias("text"))
    some = fewest(rows, docs.where("doc_id is not null").count(), F.xxhash64("doc_id"), backgrounds, "doc_id", "text")
    clean = sorted({re.sub(r"[0-9@+]+", "", r["text"]) for r in some} - {""}) or ["lorem ipsum dolor sit amet "]
    return trained(tuple(clean), windows, size, hidden, epochs)


def personal_data(docs: DataFrame, tagger: Tagger | None = None, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of docs."""
    tagger = tagger or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in together(batch):
                counts, sums, lines, added = [[], [], [], []], [], [], []
                for good, extra in found(texts, tagger, size, stride):
                    base = [(k, a, b) for k in range(4) for a, b in good[k]]
                    for k in range(4):
                        counts[k].append(len(good[k]))
                    sums.append(hashlib.sha256(_line(base).encode()).hexdigest())
                    lines.append(_line(base + extra))
                    added.append(len(extra))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(lines, pa.string()), pa.array(added, pa.int64())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
