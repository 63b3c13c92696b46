"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that finds what the patterns lose.

The patterns take e-mail addresses, IP addresses, card and telephone numbers; a match that fails its check is dropped whole, so two
card numbers side by side, or a telephone number before an address, are lost. The model reads windows of characters and tells where such
a span begins and ends:

1. one scan of every whole text gives the patterns' spans and the windows: ``width`` characters every ``stride``, where there is a digit
   or an ``@`` (every span of the four kinds holds one, so no other window can add any);
2. the model is trained in numpy on at most ``sample`` windows of each kind, and as many without any, chosen by hash from all windows; its labels
   are the spans' shapes, and pairs of them set side by side, which the patterns can't split;
3. every window is decoded (Viterbi; a span's confidence is its least marginal); what a window's edge cuts is left to the window that
   overlaps it. A text's candidates are reconciled together: those that have the form of their kind, touch no letter or digit outside and overlap
   no span of the patterns compete by confidence times length (weighted interval scheduling), so that no two overlap.

The sample is the one thing on the driver; it is bounded by parameters. A span longer than ``width - stride`` is found by the patterns alone.

Edge cases: null and empty texts have no spans. Repeated rows are read each; a null id is kept. Very long texts are scanned whole, in
time that grows with their length. Without any labelled span nothing is trained and nothing added. Only the named columns are read, so others may
have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.text import starts
from zonewatch.session import stage

# The kinds in the order in which they are listed, and the patterns.
KINDS = ["email", "ip", "card", "phone"]
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The first run of digits starts where no digit stands before; from inside a run the same four parts would follow.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, kind


@dataclass(frozen=True)
class Reader:
    """Windows, sample and model. ``least`` is the confidence that a span needs."""

    width: int = 96
    stride: int = 48
    sample: int = 200
    hidden: int = 16
    epochs: int = 16
    batch: int = 64
    rate: float = 0.02
    least: float = 0.5
    seed: int = 7
    key: str = "doc_id"
    text: str = "text"


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the whole run before an ``@``, back to the last match; so every run is read once."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        # Neither this nor any earlier start can match beyond an ``@``, so the next look begins behind it.
        past = domain.end() if domain else at + 1
        if domain:
            out.append((start, past))
        at = text.find("@", past)
    return out


def matches(text: str) -> list[tuple[Span, bool]]:
    """All matches of the four patterns, and whether each passes its check."""
    out = [((a, z, 0), True) for a, z in emails(text)]
    for m in IP.finditer(text):
        out.append(((*m.span(), 1), small_parts(m.group())))
    for m in CARD.finditer(text):
        n = digits(m.group())
        out.append(((*m.span(), 2), 12 <= len(n) <= 19 and luhn(n)))
    for m in PHONE.finditer(text):
        out.append(((*m.span(), 3), 9 <= len(digits(m.group())) <= 15))
    return out


def base_spans(text: str) -> list[Span]:
    return sorted((s for s, passed in matches(text) if passed), key=lambda s: (s[0], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def has_form(kind: int, text: str) -> bool:
    """Whether a found span has the form of its kind."""
    n = digits(text)
    if kind == 0:
        return emails(text) == [(0, len(text))]
    if kind == 1:
        return IP.fullmatch(text) is not None and small_parts(text)
    if kind == 2:
        return CARD.fullmatch(text) is not None and 12 <= len(n) <= 19 and luhn(n)
    return re.fullmatch(r"[+(]?[0-9][\x20().0-9-]+[0-9]", text) is not None and 9 <= len(n) <= 15 and text[0] in "+("


# --- the model -------------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CODES = 131  # ASCII, other letters, other characters, padding
_CLOSED = np.array([[
    y and y % 2 == 0 and x not in (y - 1, y)  # inside only after begin or inside of its kind
    for y in range(TAGS)] for x in range(TAGS)], dtype=bool)


def codes(windows: list[str], width: int) -> np.ndarray:
    flat = np.full((len(windows), width), 130, dtype=np.int64)
    for k, w in enumerate(windows):
        points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        flat[k, : len(points)] = np.where(points < 128, points, [128 if c.isalpha() else 129 for c in w] if points.max(initial=0) > 127 else 128)
    return flat


def tags(spans: list[Span], length: int, width: int) -> np.ndarray:
    """Tags of one window; a span that begins before it starts inside."""
    out = np.zeros(width, dtype=np.int64)
    for a, z, kind in spans:
        out[max(a, 0) : min(z, length)] = 2 * kind + 2
        if 0 <= a < length:
            out[a] = 2 * kind + 1
    return out


class Model:
    """Two LSTMs over one window, one from either end, with linear scores for each tag and CRF transitions between them."""

    NAMES = ("of_code", "of_state", "to_tag", "bias", "steps")

    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.hidden = hidden
        self.of_code, self.of_state = draw(0.3, 2, CODES, 4 * hidden), draw(hidden**-0.5, 2, hidden, 4 * hidden)
        self.of_code[:, :, hidden : 2 * hidden] += 1  # remember at first
        self.to_tag, self.bias, self.steps = draw(hidden**-0.5, 2, hidden, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)

    def states(self, x: np.ndarray, keep: bool = False):
        """Hidden states of both directions, ``(2, time, window, hidden)``, each in its own reading order."""
        n, time = x.shape
        size = self.hidden
        order = np.stack((x.T, x.T[::-1]))
        h, c = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        out = np.empty((2, time, n, size), np.float32)
        half = np.repeat(np.float32([0.5, 0.5, 0.5, 1]), size)
        kept = []
        for t in range(time):
            g = h @ self.of_state
            g[0] += self.of_code[0][order[0, t]]
            g[1] += self.of_code[1][order[1, t]]
            g *= half
            np.tanh(g, out=g)
            g *= half
            g += 1 - half  # input, forget and output between 0 and 1
            i, f, o, u = (g[:, :, k * size : (k + 1) * size] for k in range(4))
            before, last = c, h
            c = f * c + i * u
            s = np.tanh(c)
            h = o * s
            out[:, t] = h
            if keep:
                kept.append((g, before, s, last))
        return (out, order, kept) if keep else out

    def scores(self, states: np.ndarray) -> np.ndarray:
        return states[0] @ self.to_tag[0] + states[1][::-1] @ self.to_tag[1] + self.bias

    def _closed(self) -> np.ndarray:
        return np.where(_CLOSED, np.float32(-30), self.steps)

    def marginals(self, e: np.ndarray):
        """Forward and backward sums (scaled), marginals of each tag, and the log of the whole."""
        move = np.exp(self._closed())
        push = np.exp(e - e.max(2, keepdims=True))
        a, b, scale = np.empty_like(push), np.empty_like(push), np.empty(push.shape[:2], push.dtype)
        for t in range(len(e)):
            a[t] = push[t] if t == 0 else (a[t - 1] @ move) * push[t]
            scale[t] = a[t].sum(1)
            a[t] /= scale[t][:, None]
        b[-1] = 1
        for t in range(len(e) - 2, -1, -1):
            b[t] = ((b[t + 1] * push[t + 1]) @ move.T) / scale[t + 1][:, None]
        p = a * b
        return a, b, push, scale, p / p.sum(2, keepdims=True), (np.log(scale) + e.max(2)).sum(0)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        n, time = x.shape
        out, order, kept = self.states(x, keep=True)
        e, closed = self.scores(out), self._closed()
        a, b, push, scale, p, whole = self.marginals(e)
        y = y.T
        at = np.arange(n)
        gold = sum(e[t, at, y[t]] for t in range(time)) + sum(closed[y[t], y[t + 1]] for t in range(time - 1))
        de = p.copy()
        for t in range(time):
            de[t, at, y[t]] -= 1
        de /= n
        after = b[1:] * push[1:] / scale[1:, :, None]
        pairs = np.exp(closed) * np.einsum("tnx,tny->xy", a[:-1], after)
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
        grads = {
            "steps": np.where(_CLOSED, 0, pairs / n).astype(np.float32), "bias": de.sum((0, 1)),
            "to_tag": np.stack((np.einsum("tnh,tny->hy", out[0], de), np.einsum("tnh,tny->hy", out[1][::-1], de))),
            "of_code": np.zeros_like(self.of_code),
        }
        dout = np.stack((de @ self.to_tag[0].T, (de @ self.to_tag[1].T)[::-1]))
        dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
        size, moved = self.hidden, np.empty((2, time, n, 4 * self.hidden), dout.dtype)
        for t in range(time - 1, -1, -1):
            g, before, s, _ = kept[t]
            i, f, o, u = (g[:, :, k * size : (k + 1) * size] for k in range(4))
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - s * s)
            dg = moved[:, t]
            dg[:, :, :size] = dc * u * i * (1 - i)
            dg[:, :, size : 2 * size] = dc * before * f * (1 - f)
            dg[:, :, 2 * size : 3 * size] = dh * s * o * (1 - o)
            dg[:, :, 3 * size :] = dc * i * (1 - u * u)
            dh, dc = dg @ self.of_state.transpose(0, 2, 1), dc * f
        last = np.stack([k[3] for k in kept], axis=1).reshape(2, time * n, size)
        moved = moved.reshape(2, time * n, 4 * size)
        grads["of_state"] = last.transpose(0, 2, 1) @ moved
        for d in (0, 1):
            flat = order[d].ravel()
            by = np.argsort(flat, kind="stable")
            edge = starts(flat[by])[:-1]
            grads["of_code"][d][flat[by][edge]] = np.add.reduceat(moved[d][by], edge, axis=0)
        return float((whole - gold).mean()), grads

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best path's tags and their marginals, ``(window, time)``."""
        e, move = self.scores(self.states(x)), self._closed()
        best, back = e[0], []
        for t in range(1, len(e)):
            through = best[:, :, None] + move
            back.append(through.argmax(1))
            best = through.max(1) + e[t]
        path = np.empty(e.shape[:2], dtype=np.int64)
        path[-1] = best.argmax(1)
        at = np.arange(e.shape[1])
        for t in range(len(e) - 2, -1, -1):
            path[t] = back[t][at, path[t + 1]]
        sure = np.take_along_axis(self.marginals(e)[4], path[:, :, None], 2)[:, :, 0]
        return path.T, sure.T


def fitted(x: np.ndarray, y: np.ndarray, reader: Reader) -> Model:
    """A model trained by Adam; the same for the same windows in the same order."""
    model, rng = Model(reader.hidden, reader.seed), np.random.default_rng(reader.seed)
    mean, square = ({n: np.zeros_like(getattr(model, n)) for n in Model.NAMES} for _ in range(2))
    turn, turns = 0, reader.epochs * -(-len(x) // reader.batch)
    for _ in range(reader.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), reader.batch):
            of = order[at : at + reader.batch]
            _, grads = model.loss(x[of], y[of])
            turn += 1
            rate = reader.rate * (1 - turn / (turns + 1))
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grads.values()))) / 5)
            for name, g in grads.items():
                g = g / norm
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.99 * square[name] + 0.01 * g * g
                step = rate * (mean[name] / (1 - 0.9**turn)) / (np.sqrt(square[name] / (1 - 0.99**turn)) + 1e-8)
                setattr(model, name, (getattr(model, name) - step).astype(np.float32))
    return model


# --- windows and labels ----------------------------------------------------------------------------------------------


def places(text: str, reader: Reader) -> list[int]:
    """Where windows start: on a grid, where there is a digit or an ``@`` inside."""
    out, last = [], max(len(text) - reader.width, 0)
    steps = -(-last // reader.stride)  # the last window holds the end
    for m in re.finditer("[0-9@]", text):
        low = max(-(-(m.start() + 1 - reader.width) // reader.stride), out[-1] + 1 if out else 0, 0)
        out += range(low, min(m.start() // reader.stride, steps) + 1)
    return [k * reader.stride for k in out]


def shapes(window: str) -> tuple[list[Span], bool]:
    """Labels of a window: spans whose shape is right, checks of number left aside; and whether a match of no kind's shape is in it."""
    spans, odd = [], False
    for (a, z, kind), passed in matches(window):
        n = len(digits(window[a:z]))
        if passed or (kind == 2 and 12 <= n <= 19):
            spans.append((a, z, kind))
        elif kind == 3 or (kind == 2 and n > 19):
            odd = True
    # What looks like two kinds at once is no clear example.
    spans.sort()
    return spans, odd or any(x[1] > y[0] for x, y in zip(spans, spans[1:]))


def examples(labelled: dict[int, list[str]], clean: list[str], reader: Reader) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of the sampled windows, and of pairs of their spans set side by side in clean windows."""
    rng = np.random.default_rng(reader.seed)
    windows, labels, parts = [], [], []
    for kind in sorted(labelled):
        for w in labelled[kind]:
            spans = shapes(w)[0]
            windows.append(w), labels.append(spans)
            parts += [(w[a:z], k) for a, z, k in spans if k == kind and a > 0 and z < len(w)]
    for w in clean:
        windows.append(w), labels.append([])
    ground = clean or [" " * reader.width]
    for _ in range(3 * reader.sample if parts else 0):
        (one, k), (two, j) = (parts[rng.integers(len(parts))] for _ in range(2))
        base = ground[rng.integers(len(ground))]
        gap = (" ", " ", ", ", "; ", " - ")[rng.integers(5)]
        start = int(rng.integers(0, max(1, reader.width - len(one) - len(two) - len(gap))))
        head = re.sub("[0-9@+]", "a", base[:start]) + " "
        text = head + one + gap + two
        tail = re.sub("[0-9@+]", "a", base[len(text) :])
        # Some texts end soon.
        windows.append((text + " " + tail)[: len(text) + int(rng.integers(0, reader.width))][: reader.width])
        labels.append([(len(head), len(head) + len(one), k), (len(text) - len(two), len(text), j)])
    y = np.stack([tags(s, len(w), reader.width) for w, s in zip(windows, labels, strict=True)])
    return codes(windows, reader.width), y


def scanned(documents: DataFrame, reader: Reader) -> DataFrame:
    """For each row: the patterns' spans, the text's length, and its windows with their kinds (a bit each; -1 where no clear example)."""
    kind = documents.schema[reader.key].dataType
    window = T.StructType([T.StructField("at", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kinds", T.IntegerType())])
    schema = T.StructType([
        T.StructField("doc", kind), T.StructField("length", T.LongType()), T.StructField("base", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("windows", T.ArrayType(window)),
    ])
    listed = pa.list_(pa.struct([("at", pa.int64()), ("text", pa.string()), ("kinds", pa.int32())]))

    def of(text: str) -> list[dict]:
        out = []
        for at in places(text, reader):
            w = text[at : at + reader.width]
            spans, odd = shapes(w)
            out.append({"at": at, "text": w, "kinds": -1 if odd else sum({1 << k for _, _, k in spans})})
        return out

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([base_spans(t) for t in texts], pa.list_(pa.list_(pa.int64()))),
                    pa.array([of(t) for t in texts], listed),
                ], names=schema.names)

    return documents.select(F.col(f"`{reader.key}`").alias("doc"), F.col(f"`{reader.text}`").alias("text")).mapInArrow(run, schema)


def trained(rows: DataFrame, reader: Reader) -> Model | None:
    """A model of a bounded sample of the windows of ``rows``; None if none of them holds a span."""
    windows = rows.select(F.explode("windows").alias("w")).select("w.text", "w.kinds")
    first = lambda test: [
        r.text for r in windows.where(test).dropDuplicates(["text"]).orderBy(F.xxhash64("text"), "text").limit(reader.sample).collect()]
    labelled = {k: first(f"kinds > 0 and (kinds & {1 << k}) != 0") for k in range(len(KINDS))}
    if not any(labelled.values()):
        return None
    return fitted(*examples(labelled, first("kinds = 0"), reader), reader)


# --- decoding and reconciling ----------------------------------------------------------------------------------------


def decoded(model: Model, windows: list[str], reader: Reader) -> list[list[tuple[int, int, int, float]]]:
    """Spans of each window with their confidence."""
    out = []
    for at in range(0, len(windows), 1024):
        part = windows[at : at + 1024]
        for w, path, sure in zip(part, *model.decode(codes(part, reader.width)), strict=True):
            found = []
            if path.any():
                path = path[: len(w)]
                goes_on = (path[1:] > 0) & (path[1:] % 2 == 0) & ((path[:-1] == path[1:]) | (path[:-1] == path[1:] - 1))
                edge = np.flatnonzero(np.r_[True, ~goes_on, True])
                found = [(int(a), int(z), int(path[a] - 1) // 2, float(sure[a:z].min())) for a, z in zip(edge[:-1], edge[1:]) if path[a]]
            out.append(found)
    return out


def reconciled(candidates: list[tuple[int, int, int, float]]) -> list[Span]:
    """Of candidates ``(start, end, kind, confidence)`` the set without overlaps whose confidence times length is largest."""
    best: dict[Span, float] = {}
    for a, z, kind, sure in candidates:
        best[a, z, kind] = max(sure, best.get((a, z, kind), 0.0))
    order = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in order]
    total, taken = [0.0], [None]
    for k, (a, z, kind) in enumerate(order):
        before = int(np.searchsorted(ends[:k], a, side="right"))
        worth = total[before] + best[a, z, kind] * (z - a)
        total.append(max(worth, total[-1]))
        taken.append(before if worth > total[-2] else None)
    out, k = [], len(order)
    while k:
        if taken[k] is None:
            k -= 1
        else:
            out.append(order[k - 1])
            k = taken[k]
    return out[::-1]


def added(base: list[Span], windows: list[dict], found: list[list], length: int, reader: Reader) -> list[Span]:
    """What the model adds to the spans of the patterns in one text."""
    known = sorted(s[:2] for s in base)
    open_to = np.maximum.accumulate([z for _, z in known]) if known else np.zeros(0)
    candidates = []
    for w, spans in zip(windows, found, strict=True):
        text, at = w["text"], w["at"]
        for a, z, kind, sure in spans:
            cut = (a == 0 and at > 0) or (z == len(text) and at + z < length)
            beside = (a > 0 and text[a - 1].isalnum()) or (z < len(text) and text[z].isalnum())
            if cut or beside or sure < reader.least or not has_form(kind, text[a:z]):
                continue
            k = int(np.searchsorted([s for s, _ in known], at + z))  # spans of the patterns that start before this one ends
            if not k or open_to[k - 1] <= at + a:
                candidates.append((at + a, at + z, kind, sure))
    return reconciled(candidates)


RESULT = ["n_email", "n_ip", "n_card", "n_phone"]


def found(documents: DataFrame, reader: Reader = Reader()) -> DataFrame:
    """For each row: counts and digest of the patterns' spans, all spans, and how many the model added."""
    kind = documents.schema[reader.key].dataType
    schema = T.StructType([
        T.StructField(reader.key, kind), *[T.StructField(n, T.LongType()) for n in RESULT], T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()),
    ])
    rows = stage(scanned(documents, reader), "pii-windows", compression="zstd")
    model = trained(rows, reader)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                windows = [w or [] for w in part.column(3).to_pylist()]
                # Windows whose text stands in several places are decoded once.
                texts = sorted({w["text"] for ws in windows for w in ws})
                spans = dict(zip(texts, decoded(model, texts, reader) if model else [[]] * len(texts), strict=True))
                out = []
                for length, base, ws in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), windows, strict=True):
                    base = [tuple(s) for s in base]
                    more = added(base, ws, [spans[w["text"]] for w in ws], length, reader)
                    digest = hashlib.sha256(written(base).encode()).hexdigest()
                    out.append((*[sum(s[2] == k for s in base) for k in range(len(KINDS))], digest, written(base + more), len(more)))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()),
                    pa.array(columns[5], pa.string()), pa.array(columns[6], pa.int64()),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)
