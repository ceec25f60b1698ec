"""Personal data: base patterns, and spans that a character-level BiLSTM-CRF adds to them.

The tagger reads overlapping windows over the whole text. Where two windows overlap, what they say of a character fades
from one into the other, and one best path over the whole text reconciles all windows, so a span may lie anywhere and be
of any length. A span is added where it touches no base span and its digits or parts are those of its kind.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import groups_of_texts, short_batches, strings, text_of
from .tagger import KINDS, TAGS, Tagger, classes, luhn, trained

LOCAL, HOST = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-", re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match of these starts inside a run of digits, so the patterns needn't be tried there.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What stands for an at sign and for a dot in altered addresses.
_AT = r"(?:\s*(?:@|[\[({<] ?at ?[\])}>])\s*|\s+at\s+)"
_DOT = r"(?:\s*(?:\.|[\[({<] ?(?:dot|\.) ?[\])}>])\s*|\s+dot\s+)"
ADDRESS = re.compile(rf"[a-z0-9_%+-]+(?:{_DOT}[a-z0-9_%+-]+)*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}", re.IGNORECASE)
Span = tuple[str, int, int]
#: Characters of a window, and how far windows are apart.
WINDOW, STRIDE = 512, 456
#: Windows of a text that are merged at once; a longer text goes on from where certainly no span is.
STRETCH = 4096


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an at sign, all that may stand before it from the last match on, and the host after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := HOST.match(text, at)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    if any(d in text for d in "0123456789"):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping ranges over a whole text of n characters."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(n - WINDOW + STRIDE, 1) if n else 0, STRIDE)]


#: A later window's share of what is said of each character that it has in common with the one before.
FADE = ((np.arange(WINDOW - STRIDE) + 0.5) / (WINDOW - STRIDE)).astype(np.float32)


def merged_emissions(parts: list[tuple[np.ndarray, int, int]], tagger: Tagger, rows: int = 2048) -> list[np.ndarray]:
    """Emissions (steps, tags) of parts (classes of a text, first window, window after the last): from where the first
    window begins to where the one after the last would. A window before the first is read too, for what it shares."""
    where, out = [], []
    for k, (ids, first, stop) in enumerate(parts):
        all_ = windows(len(ids))
        begin = all_[first][0]
        end = all_[stop][0] if stop < len(all_) else len(ids)
        out.append(np.zeros((end - begin, len(TAGS)), np.float32))
        where += [(k, a, b, begin, end) for a, b in all_[max(first - 1, 0) : stop]]
    space = classes(" ")[0]
    order = sorted(where, key=lambda x: x[2] - x[1])  # the last windows of texts are shorter, and so are batches of them
    for at in range(0, len(order), rows):
        some = order[at : at + rows]
        wide = some[-1][2] - some[-1][1]
        ids = np.full((len(some), wide), space, np.uint8)
        for i, (k, a, b, _, _) in enumerate(some):
            ids[i, : b - a] = parts[k][0][a:b]
        e = np.ascontiguousarray(tagger.emissions(ids).transpose(1, 0, 2))
        for i, (k, a, b, begin, end) in enumerate(some):
            one = e[i, : b - a]
            if a > 0:
                m = min(WINDOW - STRIDE, b - a)
                one[:m] *= FADE[:m, None]
            if b < len(parts[k][0]):  # another window begins a stride after this one
                one[STRIDE:] *= 1 - FADE[: b - a - STRIDE, None]
            lo, hi = max(a, begin), min(b, end)
            out[k][lo - begin : hi - begin] += one[lo - a : hi - a]
    return out


def plausible(kind: str, text: str) -> bool:
    n = len(digits := digits_of(text))
    if kind == "email":
        return bool(ADDRESS.fullmatch(text))
    if kind == "ip":
        return len(found := re.findall(r"[0-9]+", text)) == 4 and all(len(x) < 4 and int(x) <= 255 for x in found)
    if kind == "card":
        return 13 <= n <= 19 and luhn(digits) and not re.search(r"[^\W\d_]", text)
    return 9 <= n <= 15 and not re.search(r"[^\W\d_]", text) and bool(re.search(r"[^0-9]", text))


def _spans(text: str, tags: np.ndarray, begin: int) -> list[Span]:
    """Spans of a path over text[begin:], without white space and stops at their ends."""
    out = []
    for j in np.flatnonzero(tags % 2 == 1).tolist():  # odd tags begin a span
        inside, end = int(tags[j]) + 1, j + 1
        while end < len(tags) and tags[end] == inside:
            end += 1
        raw = text[begin + j : begin + end]
        stop = begin + j + len(raw.rstrip(" \n\t.,;:"))
        if stop > begin + j:
            out.append((TAGS[int(tags[j])][2:], begin + j, stop))
    return out


def long_text_spans(text: str, tagger: Tagger) -> list[Span]:
    """Spans of the best path over a text of any length, a stretch of windows after the other.

    A stretch ends where certainly no span is; what lies after that place waits for the next stretch.
    """
    ids = classes(text)
    n, begin, held, out = len(windows(len(ids))), 0, np.zeros((0, len(TAGS)), np.float32), []
    for first in range(0, n, STRETCH):
        held = np.concatenate([held, merged_emissions([(ids, first, min(n, first + STRETCH))], tagger)[0]])
        last = first + STRETCH >= n
        found = tagger.candidates(held, begin == 0)
        done = len(held) if last else found[-1][0] if found and found[-1][1] >= len(held) - 1 else max(len(held) - 1, 0)
        some = [(a, b) for a, b in found if b <= done]
        if some:
            opens, closes = np.array([begin + a == 0 for a, _ in some]), np.array([begin + b == len(ids) for _, b in some])
            for (a, _), tags in zip(some, tagger.best_paths([held[a:b] for a, b in some], opens, closes)):
                out += _spans(text, tags, begin + a)
        held, begin = held[done:], begin + done
    return out


class Windows:
    """Windows of texts behind each other, with what the tagger says of each: `emissions` (tags, steps, windows) by batch."""

    def __init__(self, encoded: list[np.ndarray], tagger: Tagger, rows: int = 1024) -> None:
        self.encoded, self.tagger = encoded, tagger
        self.where = [(k, a, b) for k, ids in enumerate(encoded) for a, b in windows(len(ids))]
        self.first = np.concatenate([[0], np.cumsum([len(windows(len(ids))) for ids in encoded])])  # of each text
        self.place: list[tuple[int, int]] = [(0, 0)] * len(self.where)
        self.emissions: list[np.ndarray] = []
        space = classes(" ")[0]
        order = sorted(range(len(self.where)), key=lambda i: self.where[i][2] - self.where[i][1])  # short ones together
        for at in range(0, len(order), rows):
            some = order[at : at + rows]
            wide = self.where[some[-1]][2] - self.where[some[-1]][1]
            ids = np.full((len(some), wide), space, np.uint8)
            for i, w in enumerate(some):
                k, a, b = self.where[w]
                ids[i, : b - a] = encoded[k][a:b]
                self.place[w] = (len(self.emissions), i)
            self.emissions.append(tagger.emissions(ids).transpose(2, 0, 1))

    def possible_parts(self) -> list[tuple[int, int, int]]:
        """Text, begin and end of each part of texts outside of which certainly no span is.

        Bounds of what a span can gain are taken window by window and fade like the emissions: they are maxima of sums of
        these, so a faded bound is a bound of the faded emissions. Between texts is a step that no span gets over.
        """
        if not self.where:
            return []
        begin, inside = np.zeros((len(self.where), WINDOW), np.float32), np.zeros((len(self.where), WINDOW), np.float32)
        of_batch: list[list[int]] = [[] for _ in self.emissions]
        for w, (batch, _) in enumerate(self.place):
            of_batch[batch].append(w)
        for some, e in zip(of_batch, self.emissions):
            some.sort(key=lambda w: self.place[w][1])
            x, y, opening = self.tagger.bounds(e)
            starts = np.array([self.where[w][1] == 0 for w in some])
            x[0] = np.where(starts, opening[0], x[0])
            y[0] = np.where(starts, -1e6, y[0])
            begin[some, : len(x)], inside[some, : len(y)] = x.T, y.T
        later = np.flatnonzero([a > 0 for _, a, _ in self.where])
        shared = WINDOW - STRIDE
        for x in (begin, inside):
            x[later, :shared] = FADE * x[later, :shared] + (1 - FADE) * x[later - 1, STRIDE:]
        own = np.array([STRIDE if b < len(self.encoded[k]) else b - a for k, a, b in self.where])
        kept = np.arange(WINDOW) < own[:, None]
        ends = np.cumsum([len(ids) for ids in self.encoded])
        out = []
        for a, b in self.tagger.ranges(begin[kept], inside[kept]):
            k = int(np.searchsorted(ends, a, "right"))
            while a < b:  # parts of two texts may touch
                start, stop = int(ends[k]) - len(self.encoded[k]), min(b, int(ends[k]))
                if stop > a:
                    out.append((k, a - start, stop - start))
                a, k = max(a, stop), k + 1
        return out

    def merged(self, k: int, a: int, b: int) -> np.ndarray:
        """Faded emissions (steps, tags) of text k from a to b."""
        out, n = np.zeros((b - a, len(TAGS)), np.float32), len(self.encoded[k])
        for w in range(int(self.first[k]) + max(0, a - WINDOW + STRIDE) // STRIDE, int(self.first[k + 1])):
            _, begin, end = self.where[w]
            lo, hi = max(a, begin), min(b, end)
            if begin >= b:
                break
            if lo >= hi:
                continue
            batch, row = self.place[w]
            weight = np.ones(end - begin, np.float32)
            if begin > 0:
                weight[: WINDOW - STRIDE] *= FADE[: end - begin]
            if end < n:
                weight[STRIDE:] *= 1 - FADE
            out[lo - a : hi - a] += self.emissions[batch][:, lo - begin : hi - begin, row].T * weight[lo - begin : hi - begin, None]
        return out


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans on the best path over each whole text; equal texts are read once."""
    some = [t for t in dict.fromkeys(texts) if 0 < len(t) <= STRETCH * STRIDE]
    encoded = [classes(t) for t in some]
    spans: dict[str, list[Span]] = {t: [] for t in some}
    read = Windows(encoded, tagger)
    found = read.possible_parts()
    at = 0
    while at < len(found):
        stop, size = at, 0
        while stop < len(found) and (stop == at or size + found[stop][2] - found[stop][1] <= 200_000):  # a bounded block of scores
            size += found[stop][2] - found[stop][1]
            stop += 1
        block = found[at:stop]
        opens, closes = np.array([a == 0 for _, a, _ in block]), np.array([b == len(encoded[k]) for k, _, b in block])
        for (k, a, _), tags in zip(block, tagger.best_paths([read.merged(*x) for x in block], opens, closes)):
            spans[some[k]] += _spans(some[k], tags, a)
        at = stop
    spans |= {t: long_text_spans(t, tagger) for t in dict.fromkeys(texts) if len(t) > STRETCH * STRIDE}
    return [spans.get(t, []) for t in texts]


def added_spans(text: str, base: list[Span], tagged: list[Span]) -> list[Span]:
    return [(kind, a, b) for kind, a, b in tagged if plausible(kind, text[a:b]) and all(b <= x or y <= a for _, x, y in base)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), *x[1:])))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span as [KIND]; spans that overlap become one, named after the first."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def spans_of_texts(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each whole text."""
    base = [base_spans(text) for text in texts]
    return [(b, added_spans(text, b, tagged)) for text, b, tagged in zip(texts, base, tagged_spans(texts, tagger), strict=True)]


_trained: dict[str, Tagger] = {}


def trained_in_a_task(spark: SparkSession) -> Tagger:
    """The tagger that `trained` makes, made by one task so that the driver holds its few parameters only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained())])], names=["tagger"])

    if "tagger" not in _trained:
        _trained["tagger"] = pickle.loads(spark.range(1).coalesce(1).mapInArrow(run, "tagger binary").first()[0])
    return _trained["tagger"]


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of each row's whole text.

    A null text counts as empty and has no spans. Rows with equal doc_ids stay separate rows; other columns aren't
    looked at; no rows give no rows. n_email to n_phone count base spans, as base_sha256 covers them.
    """
    short_batches(docs.sparkSession)
    tagger = tagger or trained_in_a_task(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for begin, end in groups_of_texts(texts):
                found = spans_of_texts(texts[begin:end], tagger)
                columns = [pa.array([sum(s[0] == kind for s in b) for b, _ in found], pa.int64()) for kind in KINDS]
                columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]), pa.array([joined(b + x) for b, x in found]), pa.array([len(x) for _, x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *columns], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, schema)


def mask(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with all its columns, its text with each span as [KIND]. A null text becomes empty."""
    short_batches(docs.sparkSession)
    tagger = tagger or trained_in_a_task(docs.sparkSession)
    at = docs.columns.index("text")
    docs = docs.withColumn("text", text_of(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, new = strings(batch.column(at)), []
            for begin, end in groups_of_texts(texts):
                some = texts[begin:end]
                new += [masked(text, b + x) if b or x else text for text, (b, x) in zip(some, spans_of_texts(some, tagger), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

