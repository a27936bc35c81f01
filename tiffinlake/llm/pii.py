"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions beside them.

The patterns find the base spans. Their matches in a bounded sample of texts
are the labelled spans that the network learns from; it then reads each text in
overlapping windows. The scores of all windows of a stretch of text are merged,
nearer to a window's middle counting more, and the best tags of the stretch are
found in one pass over all of it, so that a span across windows is one span. A
long stretch is decoded in blocks of 1,024 characters that reach 256 into their
neighbours, and all stretches of a slice of texts together. What the network
finds is added where no base span lies.

All kinds of data here hold a digit or an @, so that windows without either
have no span and are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffinlake.llm.common import boxed, sampled, slices

# The kinds in their order, and what a match of each has to be.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")

WINDOW, STRIDE, HIDDEN = 64, 32, 16
#: Texts with a digit or an @ that the network is fitted on at most, and windows of them.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 600, 4_000
STEPS, BATCH, RATE = 400, 48, 0.02
#: How much better than "nothing here" the network must score a span, in nats a character.
MARGIN = 0.5
#: Shortest span that the network may add.
SHORTEST = 7
#: Cells, of a stride each, that are decoded at once of a long stretch, how far blocks reach into others, and cells read at a time.
BLOCK, MARGIN_CELLS, GROUP_CELLS = 32, 8, 8_192
#: Bytes of text that are tagged at a time, or a single longer text.
TAGGED_BYTES = 1 << 20

TAGS = 1 + 2 * len(KINDS)
_CHARS = 98
_NEVER = -1e4


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    base: bool


def _order(span: Span) -> tuple:
    return span.start, KINDS.index(span.kind), span.end


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and non-overlapping for each kind, in order.

    An address is found from its @ on: the characters before it are part of it
    as far back as they may be, down to the last match. All patterns take time
    in proportion to the text.
    """
    if not _SIGN.search(text):
        return []
    found = []
    last = 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            found.append(Span(start, match.end(), "email", True))
            last = match.end()
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match[0].split(".")):
            found.append(Span(*match.span(), "ip", True))
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(Span(*match.span(), "card", True))
    for match in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in match[0]) <= 15:
            found.append(Span(*match.span(), "phone", True))
    return sorted(found, key=_order)


def plausible(kind: str, text: str) -> bool:
    """Whether a span has the parts or digits that its kind has, however they are set apart."""
    digits = re.findall("[0-9]+", text)
    count = sum(map(len, digits))
    if kind == "email":
        return "@" in text[1:-1]
    if kind == "ip":
        return len(digits) == 4 and all(len(d) <= 3 and int(d) <= 255 for d in digits)
    if kind == "card":
        return 12 <= count <= 19 and luhn("".join(digits))
    return 9 <= count <= 15


def char_ids(text: str) -> np.ndarray:
    """Each printable ASCII character by itself, white space, other letters and digits, anything else."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where((codes >= 32) & (codes < 127), codes - 32, np.where(codes < 32, 95, np.where(codes >= 192, 96, 97)))
    return out.astype(np.int8)


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Where windows with a digit or an @ begin, a stride apart."""
    signs = ((ids >= 16) & (ids < 26)) | (ids == 32)
    cells = np.flatnonzero(np.logical_or.reduceat(signs, np.arange(0, len(ids), STRIDE))) if len(ids) else np.empty(0, np.int64)
    return np.unique(np.concatenate((cells, cells[cells > 0] - 1))) * STRIDE if len(cells) else cells


def _windowed(ids: np.ndarray, starts: np.ndarray, fill: int) -> np.ndarray:
    padded = np.concatenate((ids, np.full(WINDOW + STRIDE, fill, ids.dtype)))
    return padded[starts[:, None] + np.arange(WINDOW)]


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    """0 outside; for kind k 1 + 2 k at the first character of a span and 2 + 2 k within; the first span counts."""
    tags = np.zeros(length, np.int64)
    for span in spans:
        if not tags[span.start : span.end].any():
            kind = 1 + 2 * KINDS.index(span.kind)
            tags[span.start : span.end] = kind + 1
            tags[span.start] = kind
    return tags


def _allowed() -> np.ndarray:
    """Transitions: a span goes on only within its own kind."""
    out = np.zeros((TAGS, TAGS))
    for tag in range(2, TAGS, 2):
        out[:, tag] = _NEVER
        out[[tag - 1, tag], tag] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _read(table: np.ndarray, inner: np.ndarray, ids: np.ndarray, keep: bool = False):
    """An LSTM over (time, batch): its outputs, and what the way back needs."""
    h = np.zeros((ids.shape[1], HIDDEN), table.dtype)
    c, out, steps = h, [], []
    for row in ids:
        z = table[row] + h @ inner
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = (h, c)
        c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * g
        squashed = np.tanh(c)
        h = gates[:, 2 * HIDDEN :] * squashed
        out.append(h)
        if keep:
            steps.append((*before, gates, g, squashed))
    return np.stack(out), steps


def _back(table: np.ndarray, inner: np.ndarray, ids: np.ndarray, steps: list, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the table and the inner weights from those of the outputs."""
    to_inner = np.zeros_like(inner)
    dh = dc = np.zeros_like(slope[0])
    by_char = []
    for t in range(len(ids) - 1, -1, -1):
        h0, c0, gates, g, squashed = steps[t]
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        dh = dh + slope[t]
        dc = dc + dh * o * (1 - squashed * squashed)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        to_inner += h0.T @ dz
        by_char.append(dz)
        dh, dc = dz @ inner.T, dc * f
    order = np.argsort(ids.ravel(), kind="stable")
    chars, begins = np.unique(ids.ravel()[order], return_index=True)
    to_table = np.zeros_like(table)
    to_table[chars] = np.add.reduceat(np.concatenate(by_char[::-1])[order], begins)
    return to_table, to_inner


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights: character tables and inner weights of both directions, output, transitions, first tags."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def random(cls, seed: int = 5) -> Tagger:
        r = np.random.default_rng(seed)
        tables = [r.normal(0, 0.3, (_CHARS, 4 * HIDDEN)) for _ in range(2)]
        for table in tables:
            table[:, HIDDEN : 2 * HIDDEN] += 1.0
        inner = [r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)) for _ in range(2)]
        return cls([*tables, *inner, r.normal(0, HIDDEN**-0.5, (2 * HIDDEN, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS)])

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """(batch, time) of characters -> (batch, time, tag)."""
        w = [x.astype(np.float32) for x in self.weights[:6]]
        out = np.empty((*windows.shape, TAGS), np.float32)
        for at in range(0, len(windows), 2048):
            ids = windows[at : at + 2048].T
            ahead, _ = _read(w[0], w[2], ids)
            back, _ = _read(w[1], w[3], ids[::-1])
            out[at : at + 2048] = (np.concatenate([ahead, back[::-1]], axis=2) @ w[4] + w[5]).transpose(1, 0, 2)
        return out

    def slopes(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss of the CRF, the mean over windows, and its slopes."""
        w, ids, tags = self.weights, windows.T, tags.T
        ahead, steps_a = _read(w[0], w[2], ids, True)
        back, steps_b = _read(w[1], w[3], ids[::-1], True)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        emitted = both @ w[4] + w[5]
        change = w[6] + _allowed()
        first = w[7] + np.where(np.arange(TAGS) % 2, 0, np.where(np.arange(TAGS), _NEVER, 0))
        time, batch = ids.shape
        forth, rest = [first + emitted[0]], [np.zeros((batch, TAGS))]
        for t in range(1, time):
            forth.append(_log_sum(forth[-1][:, :, None] + change, 1) + emitted[t])
            rest.append(_log_sum(change + (emitted[time - t] + rest[-1])[:, None, :], 2))
        rest = rest[::-1]
        total = _log_sum(forth[-1], 1)
        column = np.arange(batch)
        likely = np.exp(np.stack(forth) + np.stack(rest) - total[:, None])
        d_emitted = likely.copy()
        d_emitted[np.arange(time)[:, None], column, tags] -= 1
        d_emitted /= batch
        d_change = np.zeros((TAGS, TAGS))
        gold = first[tags[0]] + emitted[0, column, tags[0]]
        for t in range(1, time):
            pair = np.exp(forth[t - 1][:, :, None] + change + (emitted[t] + rest[t])[:, None, :] - total[:, None, None])
            d_change += pair.sum(axis=0)
            np.add.at(d_change, (tags[t - 1], tags[t]), -1)
            gold = gold + change[tags[t - 1], tags[t]] + emitted[t, column, tags[t]]
        d_first = likely[0].sum(axis=0) - np.bincount(tags[0], minlength=TAGS)
        d_both = d_emitted @ w[4].T
        t_a, i_a = _back(w[0], w[2], ids, steps_a, d_both[:, :, :HIDDEN])
        t_b, i_b = _back(w[1], w[3], ids[::-1], steps_b, d_both[::-1, :, HIDDEN:])
        d_out = np.einsum("tbh,tbk->hk", both, d_emitted)
        return float((total - gold).mean()), [t_a, t_b, i_a, i_b, d_out, d_emitted.sum(axis=(0, 1)), d_change / batch, d_first / batch]

    def best(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags of stretches, all of them a character at a time: (stretch, time, tag) -> (stretch, time).

        A stretch has `lengths` characters; what is behind them is 0.
        """
        change = (self.weights[6] + _allowed()).astype(np.float32)
        first = (self.weights[7] + np.where(np.arange(TAGS) % 2, 0, np.where(np.arange(TAGS), _NEVER, 0))).astype(np.float32)
        # The longest first: those that go on at a time are the first ones.
        order = np.argsort(-lengths, kind="stable")
        scores, lengths = scores[order], lengths[order]
        count, time, _ = scores.shape
        going = np.searchsorted(-lengths, -np.arange(time), side="left")
        top = first + scores[:, 0]
        came = np.zeros((time, count, TAGS), np.int8)
        for t in range(1, time):
            n = going[t]
            through = top[:n, :, None] + change
            came[t, :n] = through.argmax(axis=1)
            top[:n] = through.max(axis=1) + scores[:n, t]
            top[:n] -= top[:n].max(axis=1, keepdims=True)
        path = np.zeros((count, time), np.int8)
        now = top.argmax(axis=1)
        for t in range(time - 1, -1, -1):
            n = going[t]
            path[:n, t] = now[:n]
            now[:n] = came[t, np.arange(n), now[:n]]
        out = np.empty_like(path)
        out[order] = path
        return out


def fit(windows: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 5) -> Tagger:
    """Adam over batches of windows, the same for the same windows."""
    tagger, random = Tagger.random(seed), np.random.default_rng(seed)
    first, second = [np.zeros_like(w) for w in tagger.weights], [np.zeros_like(w) for w in tagger.weights]
    for step in range(1, steps + 1):
        chosen = random.integers(0, len(windows), BATCH)
        _, slopes = tagger.slopes(windows[chosen], tags[chosen])
        size = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        rate = RATE * (1 - 0.9 * step / steps)
        for w, m, v, g in zip(tagger.weights, first, second, slopes, strict=True):
            g = g * min(1.0, 5.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tagger


_MIDDLE = (1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)[:, None]


def _merged(tagger: Tagger, ids: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """(cell, character, tag): scores of cells, of a stride each, from the windows of which they are a half.

    A window is two cells; `cells` are in order, and a window begins at each
    but the last of a run and at no other.
    """
    runs = np.flatnonzero(np.diff(cells, append=-9) == 1)
    read = tagger.scores(_windowed(ids, cells[runs] * STRIDE, 95))
    out, weight = np.zeros((len(cells), STRIDE, TAGS), np.float32), np.zeros((len(cells), STRIDE, 1), np.float32)
    for half, at in ((slice(0, STRIDE), runs), (slice(STRIDE, WINDOW), runs + 1)):
        out[at] += read[:, half] * _MIDDLE[half]
        weight[at] += _MIDDLE[half]
    return out / np.maximum(weight, 1)


def _blocks(cells: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Begin and end of each block of cells, and of what it decides on, as places in `cells`.

    A stretch of more than BLOCK cells is cut into blocks that reach MARGIN_CELLS
    into their neighbours, by where their best paths have long met.
    """
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(cells) > 1) + 1, [len(cells)]))
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for own in range(begin, end, BLOCK):
            stop = min(own + BLOCK, end)
            yield max(begin, own - MARGIN_CELLS), min(end, stop + MARGIN_CELLS), own, stop


def _decoded(tagger: Tagger, scores: np.ndarray, blocks: list[tuple[int, int, int, int]], ends: np.ndarray) -> list[np.ndarray]:
    """The best tags of what each block decides on. ends: characters in each cell."""
    longest = max(hi - lo for lo, hi, _, _ in blocks)
    grid = np.zeros((len(blocks), longest * STRIDE, TAGS), np.float32)
    lengths = np.empty(len(blocks), np.int64)
    for i, (lo, hi, _, _) in enumerate(blocks):
        grid[i, : (hi - lo) * STRIDE] = scores[lo:hi].reshape(-1, TAGS)
        lengths[i] = ends[lo:hi].sum()
    tags = tagger.best(grid, lengths)
    return [tags[i, (own - lo) * STRIDE : (own - lo) * STRIDE + int(ends[own:stop].sum())] for i, (lo, _, own, stop) in enumerate(blocks)]


def _gains(scores: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return scores[np.arange(len(tags)), tags] - scores[:, 0]


def network_spans(tagger: Tagger, values: list[str]) -> list[list[Span]]:
    """What the network finds in each of some texts: windows and stretches of all of them are read together.

    Some GROUP_CELLS cells are read at a time, so that memory beyond the texts
    and a few bytes a character is bounded, however long a text is.
    """
    ids = [char_ids(v) for v in values]
    found: list[list[Span]] = [[] for _ in values]
    # Texts behind one another, a gap of cells between them, so that one pass reads all.
    begins = np.cumsum([0, *(len(i) // STRIDE + 4 for i in ids)]) * STRIDE
    joined = np.full(int(begins[-1]) + WINDOW, 95, np.int8)
    ends = np.zeros(int(begins[-1]) // STRIDE + 2, np.int64)
    starts = []
    for own, begin in zip(ids, begins[:-1].tolist(), strict=True):
        joined[begin : begin + len(own)] = own
        cell = begin // STRIDE
        ends[cell : cell + len(own) // STRIDE] = STRIDE
        ends[cell + len(own) // STRIDE] = len(own) % STRIDE
        starts.append(windows_of(own) + begin)
    heads = np.concatenate([*starts, np.empty(0, np.int64)]).astype(np.int64) // STRIDE
    if not len(heads):
        return found
    # A window's second half may lie behind the text.
    cells = np.unique(np.concatenate((heads, heads + 1)))
    length = ends[cells]
    tags, gains = np.zeros((len(cells), STRIDE), np.int8), np.zeros((len(cells), STRIDE), np.float32)
    todo: list[tuple[int, int, int, int]] = []

    def settle() -> None:
        low, high = min(b[0] for b in todo), max(b[1] for b in todo)
        # A window more on either side, if there is one, gives cells at the borders both their halves.
        first, last = max(0, low - 1), min(len(cells), high + 1)
        scores = _merged(tagger, joined, cells[first:last])
        moved = [tuple(x - first for x in b) for b in todo]
        # Blocks of like length share a matrix.
        moved.sort(key=lambda b: b[1] - b[0])
        sized = np.array([b[1] - b[0] for b in moved])
        for part in np.split(np.arange(len(moved)), np.flatnonzero(np.diff(np.ceil(np.log2(sized)))) + 1):
            own = [moved[i] for i in part]
            for (_, _, begin, stop), best in zip(own, _decoded(tagger, scores, own, length[first:last]), strict=True):
                at = slice(first + begin, first + stop)
                tags[at].reshape(-1)[: len(best)] = best
                gains[at].reshape(-1)[: len(best)] = _gains(scores[begin:stop].reshape(-1, TAGS)[: len(best)], best)
        todo.clear()

    for block in _blocks(cells):
        if todo and block[1] - todo[0][0] > GROUP_CELLS:
            settle()
        todo.append(block)
    settle()
    tags, gains = tags.ravel(), gains.ravel()
    marks = np.flatnonzero(tags % 2)
    # A span goes on to where the tags do, into the next cell if there is no gap.
    goes_on = np.zeros(len(tags), bool)
    goes_on[:-1] = (tags[1:] > 0) & (tags[1:] % 2 == 0) & (tags[1:] == tags[:-1] + tags[:-1] % 2)
    goes_on[STRIDE - 1 :: STRIDE] &= np.diff(cells, append=-9) == 1
    stops = np.flatnonzero(~goes_on)
    tails = stops[np.searchsorted(stops, marks)] + 1
    sums = np.add.reduceat(np.append(gains, 0), np.stack([marks, tails], axis=1).ravel())[::2] if len(marks) else []
    for head, tail, gain in zip(marks.tolist(), tails.tolist(), sums, strict=True):
        if tail - head >= SHORTEST and gain / (tail - head) >= MARGIN:
            place = int(cells[head // STRIDE]) * STRIDE + head % STRIDE
            text = int(np.searchsorted(begins, place, side="right")) - 1
            start = place - int(begins[text])
            found[text].append(Span(start, start + tail - head, KINDS[(int(tags[head]) - 1) // 2], False))
    return found


def all_spans(tagger: Tagger | None, values: list[str]) -> list[list[Span]]:
    """Base spans, and plausible ones of the network that overlap none of them, in order."""
    base = [base_spans(v) for v in values]
    if tagger is None:
        return base
    out = []
    for text, known, added in zip(values, base, network_spans(tagger, values), strict=True):
        free = [
            s
            for s in added
            if plausible(s.kind, text[s.start : s.end]) and all(s.end <= b.start or b.end <= s.start for b in known)
        ]
        out.append(sorted([*known, *free], key=_order))
    return out


def learn(docs: DataFrame, most_texts: int = SAMPLE_TEXTS, steps: int = STEPS) -> Tagger | None:
    """Fit on windows of up to `most_texts` texts that have a digit or an @, first by a hash of id and text.

    It runs as one task over that sample. None if it holds no labelled span.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, tags = [], []
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids = char_ids(text)
                starts = windows_of(ids)
                starts = starts[:: max(1, len(starts) // 50)]
                windows.append(_windowed(ids, starts, 95))
                tags.append(_windowed(tags_of(len(text), base_spans(text)), starts, 0))
        windows, tags = np.concatenate([*windows, np.zeros((0, WINDOW), np.int64)]), np.concatenate([*tags, np.zeros((0, WINDOW), np.int64)])
        # A window may begin within a span: there its first tag is that of a beginning.
        tags[:, 0] -= (tags[:, 0] > 0) & (tags[:, 0] % 2 == 0)
        chosen = np.random.default_rng(5).permutation(len(windows))[:SAMPLE_WINDOWS]
        if tags[chosen].any():
            blob = pickle.dumps([w.astype(np.float32) for w in fit(windows[chosen], tags[chosen], steps).weights])
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["model"])

    signed = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    rows = sampled(signed, most_texts, "doc_id", "text").select("text").coalesce(1).mapInArrow(step, "model binary").collect()
    return Tagger([w.astype(float) for w in pickle.loads(rows[0].model)]) if rows else None


def find(docs: DataFrame, tagger: Tagger | None, keep: list[str]) -> DataFrame:
    """Columns `keep` of each row and `spans`: start and end (exclusive) in code points, kind, and whether a pattern found it."""
    narrow = docs.select(*keep, "text")
    kinds = ", ".join(f"`{n}` {t}" for n, t in narrow.select(*keep).dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(None if tagger is None else tagger.weights)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared.value is None else Tagger(shared.value)
        for batch in batches:
            for part in slices(batch, "text", TAGGED_BYTES):
                found = all_spans(own, [t or "" for t in part.column("text").to_pylist()])
                lists = pa.array([[s._asdict() for s in spans] for spans in found], pa.list_(span))
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, lists], [*keep, "spans"])

    return narrow.mapInArrow(step, f"{kinds}, spans array<struct<start:int,end:int,kind:string,base:boolean>>")


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """`docs` with each span in `text` replaced by its kind in angle brackets; overlapping spans become one."""
    found = find(boxed(docs, "text"), tagger, ["_row"])

    def cut(text: str | None, spans: list[dict]) -> str | None:
        out, last = [], 0
        for s in spans:
            if s["start"] >= last:
                out += [text[last : s["start"]], f"<{s['kind']}>"]
            last = max(last, s["end"])
        return text if text is None else "".join([*out, text[last:]])

    narrow = found.select("_row", F.col("_row.text").alias("text"), "spans")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "text"])

    cut_rows = narrow.mapInArrow(step, narrow.select("_row", "text").schema)
    return cut_rows.select(F.col("_row").withField("text", F.col("text")).alias("_row")).select("_row.*")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, how many base spans of each kind, the SHA-256 of these, and all spans as text, for each row of `docs`.

    A span is kind:start:end; spans are in order of start, then kind, joined by
    commas. A null text is empty.
    """
    found = find(docs.select("doc_id", "text"), learn(docs), ["doc_id"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[Span(s["start"], s["end"], s["kind"], s["base"]) for s in spans] for spans in batch.column("spans").to_pylist()]
            written = [[f"{s.kind}:{s.start}:{s.end}" for s in spans] for spans in rows]
            based = [",".join(w for w, s in zip(texts, spans, strict=True) if s.base) for texts, spans in zip(written, rows, strict=True)]
            counts = [pa.array([sum(s.base and s.kind == k for s in spans) for spans in rows], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *counts,
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in based], pa.string()),
                    pa.array([",".join(w) for w in written], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return found.mapInArrow(step, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
