"""Private data: fixed patterns, and a linear-chain CRF over word shapes that adds to what they find.

Base spans come from linear-time scans of the whole text. The CRF labels whole texts: a word that holds neither a digit nor an at sign has
the label O by definition of the label set, which parts the chain, so decoding windows of REACH words around all other words gives the very
path of the whole chain. It is trained on the driver from a small labelled table that rules below write out, and decoded by Viterbi in numpy
batches. CRF spans that overlap no base span of any kind are added.

Null and empty texts have no spans, an empty table no rows. Repeated rows give repeated results, a null doc_id stays null; columns beyond
doc_id and text are ignored by find() and kept by redact(), whatever their names. A text of any length is scanned whole. Ties: spans of one
start are in the order of KINDS; where a base and a CRF span meet, the base one stays; of equal paths Viterbi takes the label listed first.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
REACH = 2  # words on either side of a trigger
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = re.compile(r"A+|a+|0+|[^Aa0]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """A local part must run up to the at sign, so each at sign has one candidate; scanning from there is linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, 0, m.end()
            end = m.end()
        else:
            end = at + 1  # the class lacks the at sign: no later match starts before it
        at = text.find("@", end)


def base_spans(text: str | None) -> list[Span]:
    """(start, kind, end) in code points, sorted."""
    if not text or not _TRIGGER.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the CRF ----


def shape(word: str) -> str:
    """Letters and digits as runs: 'Jo-17' is 'Aa-0'."""
    cls = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdecimal() else c for c in word)
    return "".join(r[0] for r in _RUNS.findall(cls))


def _features(ws: list[str]) -> list[list[str]]:
    shapes = [shape(w) for w in ws]
    out = []
    for i, w in enumerate(ws):
        digits = sum(c.isdecimal() for c in w)
        f = ["bias", f"s={shapes[i]}", f"d={min(digits, 20)}", f"at={'@' in w}", f"dots={min(w.count('.'), 4)}", f"plus={w[:1] == '+'}", f"par={w[:1] == '('}"]
        f.append(f"l={len(shapes[i - 1]) and shapes[i - 1]}" if i else "l=^")
        f.append(f"r={shapes[i + 1]}" if i + 1 < len(ws) else "r=$")
        parts = w.strip(".,;:!?()[]\"'").split(".")
        f.append(f"quad={len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
        f.append(f"has={bool(_TRIGGER.search(w))}")
        out.append(f)
    return out


def labelled_table(seed: int = 11, n: int = 360) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (words, labels) lines made by rule, with private data of each kind and look-alikes that are none."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    low = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9)))
    plain = lambda: (w := low(), w.capitalize(), w + rng.choice(".,"))[rng.choice((0, 0, 0, 1, 2))]
    out = []
    for i in range(n):
        pick = i % 12
        tail = rng.choice(("", "", ".", ","))
        if pick == 0:
            core, kind = [f"{low()}.{num(2)}@{low()}{num(1)}.{low()}.com{tail}"], "email"
        elif pick == 1:
            core, kind = [f"{low()}@{low()}.org{tail}"], "email"
        elif pick == 2:
            core, kind = [".".join(str(rng.randint(0, 255)) for _ in range(4)) + tail], "ip"
        elif pick == 3:
            core, kind = [num(16) + tail], "card"
        elif pick == 4:
            core, kind = [num(4), num(4), num(4), num(4) + tail], "card"
        elif pick == 5:
            core, kind = ["-".join(num(4) for _ in range(4)) + tail], "card"
        elif pick == 6:
            core, kind = ["+1", f"({num(3)})", f"{num(3)}-{num(4)}{tail}"], "phone"
        elif pick == 7:
            core, kind = [f"({num(3)})", f"{num(3)}-{num(4)}{tail}"], "phone"
        elif pick == 8:
            core, kind = [f"{num(3)}-{num(3)}-{num(4)}{tail}"], "phone"
        elif pick == 9:
            core, kind = rng.choice(([f"\"{rng.randbytes(20).hex()}\""], ["=", f"\"{rng.randbytes(16).hex()}\""], [f"v{num(1)}.{num(1)}.{num(2)}"])), "O"
        elif pick == 10:
            core, kind = rng.choice(([num(4) + tail], [num(1) + "." + num(1) + tail], [f"{num(4)}-{num(2)}-{num(2)}"], [f"{num(2)}:{num(2)}"], [f"${num(3)}.{num(2)}"], [num(rng.randint(1, 8))])), "O"
        else:
            core, kind = [plain()], "O"
        left, right = [plain() for _ in range(rng.randint(0, 4))], [plain() for _ in range(rng.randint(0, 4))]
        out.append((left + core + right, ["O"] * len(left) + [kind] * len(core) + ["O"] * len(right)))
    return out


def _viterbi(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of a padded batch: emit (n, t, labels); what follows a sequence's end is arbitrary."""
    n, t, k = emit.shape
    back = np.zeros((n, t, k), np.int8)
    score = emit[:, 0].copy()
    final = score.copy()
    for i in range(1, t):
        step = score[:, :, None] + trans[None]
        back[:, i] = step.argmax(1)
        score = step.max(1) + emit[:, i]
        final[lengths == i + 1] = score[lengths == i + 1]
    path = np.zeros((n, t), np.int8)
    last = final.argmax(1)
    rows = np.arange(n)
    for i in range(t - 1, -1, -1):
        inside = i < lengths
        at_end = i == lengths - 1
        nxt = path[:, i + 1] if i + 1 < t else last
        path[:, i] = np.where(at_end, last, np.where(inside, back[rows, min(i + 1, t - 1), nxt], 0))
    return path


def train(table: list[tuple[list[str], list[str]]], epochs: int = 60, l2: float = 0.02, rate: float = 0.5) -> dict:
    """Weights by full-batch AdaGrad on the conditional log-likelihood; forward-backward over the padded table. Deterministic."""
    feats = [_features(ws) for ws, _ in table]
    index = {f: i for i, f in enumerate(sorted({f for doc in feats for row in doc for f in row}))}
    n, t, k = len(table), max(len(ws) for ws, _ in table), len(LABELS)
    width = max(len(r) for d in feats for r in d)
    x = np.full((n, t, width), len(index))
    y, mask = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (doc, (_, labels)) in enumerate(zip(feats, table, strict=True)):
        for j, row in enumerate(doc):
            x[i, j, : len(row)] = [index[f] for f in row]
            y[i, j], mask[i, j] = LABELS.index(labels[j]), True
    w, trans = np.zeros((len(index) + 1, k)), np.zeros((k, k))
    gw, gt = np.full(w.shape, 1e-6), np.full(trans.shape, 1e-6)
    gold = np.eye(k)[y] * mask[..., None]
    pair_gold = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    lengths = mask.sum(1)

    def lse(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(epochs):
        emit = w[x].sum(2)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = emit[:, 0]
        for i in range(1, t):
            alpha[:, i] = np.where(mask[:, i, None], lse(alpha[:, i - 1, :, None] + trans, 1) + emit[:, i], alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(mask[:, i + 1, None], lse(trans + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = lse(alpha[np.arange(n), lengths - 1], 1)
        prob = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pairs = np.exp(alpha[:, :-1, :, None] + trans + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        dw = np.zeros_like(w)
        np.add.at(dw, x, (gold - prob)[:, :, None, :])
        dw[-1] = 0
        dt = pair_gold - pairs.sum((0, 1))
        dw, dt = dw / n - l2 * w / n, dt / n - l2 * trans / n
        gw += dw**2
        gt += dt**2
        w += rate * dw / np.sqrt(gw)
        trans += rate * dt / np.sqrt(gt)
    w[-1] = 0
    return {"index": index, "w": w, "trans": trans}


@lru_cache(maxsize=1)
def default_model() -> dict:
    return train(labelled_table())


def segments(text: str) -> list[list[tuple[int, int]]]:
    """Word spans in windows around each trigger word; windows that touch are one."""
    hits, out = [m.start() for m in _TRIGGER.finditer(text)], []
    last_end = -1
    for h in hits:
        if h < last_end:
            continue
        # the word around h, then REACH words each way
        left = right = h
        while left > 0 and not _space(text[left - 1]):
            left -= 1
        while right < len(text) and not _space(text[right]):
            right += 1
        window = [(left, right)]
        pos = left
        for _ in range(REACH):
            e = pos
            while e > 0 and _space(text[e - 1]):
                e -= 1
            s = e
            while s > 0 and not _space(text[s - 1]):
                s -= 1
            if s == e:
                break
            window.insert(0, (s, e))
            pos = s
        pos = right
        for _ in range(REACH):
            m = _WORD.search(text, pos)
            if not m:
                break
            window.append(m.span())
            pos = m.end()
        last_end = right
        if out and window[0][0] <= out[-1][-1][1]:
            have = out[-1][-1][0]
            out[-1].extend(s for s in window if s[0] > have)
        else:
            out.append(window)
    return out


def _space(c: str) -> bool:
    return c == " " or "\t" <= c <= "\r"


def crf_spans(texts: list[str | None], model: dict) -> list[list[Span]]:
    """Spans that the CRF labels in each text; a batch at a time, sequences padded to the next power of two."""
    index, w, trans = model["index"], model["w"], model["trans"]
    jobs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    out: list[list[Span]] = [[] for _ in texts]
    for i, text in enumerate(texts):
        if text and _TRIGGER.search(text):
            for seg in segments(text):
                jobs.setdefault(1 << (len(seg) - 1).bit_length(), []).append((i, seg))
    for t, group in jobs.items():
        step = max(1, 65536 // t)
        for at in range(0, len(group), step):
            part = group[at : at + step]
            emit = np.zeros((len(part), t, len(LABELS)))
            for r, (i, seg) in enumerate(part):
                ws = [texts[i][s:e] for s, e in seg]
                for j, row in enumerate(_features(ws)):
                    emit[r, j] = w[[index.get(f, -1) for f in row]].sum(0)
                    if not _TRIGGER.search(ws[j]):
                        emit[r, j, 1:] = -1e9
            lengths = np.array([len(seg) for _, seg in part])
            for (i, seg), path in zip(part, _viterbi(emit, trans, lengths), strict=True):
                j = 0
                while j < len(seg):
                    k, first = path[j], j
                    while j < len(seg) and path[j] == k:
                        j += 1
                    if k:
                        out[i].append((seg[first][0], int(k) - 1, seg[j - 1][1]))
    for i, spans in enumerate(out):
        text = texts[i]
        trimmed = []
        for s, k, e in spans:
            while e > s and text[e - 1] in ".,;:!?\"')]":
                e -= 1
            while s < e and text[s] in "\"'[":
                s += 1
            if e > s:
                trimmed.append((s, k, e))
        out[i] = trimmed
    return out


def all_spans(texts: list[str | None], model: dict) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) for each text; a CRF span counts where it overlaps no base span of any kind."""
    out = []
    for text, found in zip(texts, crf_spans(texts, model), strict=True):
        base = base_spans(text)
        ends, extra, i, reach = sorted((s, e) for s, _, e in base), [], 0, 0
        for s, k, e in sorted(found):
            while i < len(ends) and ends[i][0] < e:
                reach = max(reach, ends[i][1])
                i += 1
            if reach <= s:
                extra.append((s, k, e))
        out.append((base, sorted(base + extra)))
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, one row per row of docs(doc_id, text)."""
    model = default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = all_spans(b.column(1).to_pylist(), model)
            counts = [[sum(k == i for _, k, _ in base) for base, _ in found] for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(render(x).encode()).hexdigest() for x, _ in found]), pa.array([render(y) for _, y in found], pa.string()), pa.array([len(y) - len(x) for x, y in found], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not spans:
        return text
    out, pos = [], 0
    for s, k, e in spans:
        if s >= pos:
            out += [text[pos:s], f"<{KINDS[k]}>"]
        pos = max(pos, e)
    return "".join([*out, text[pos:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of text masked and n_chars, where there is such a column, counted anew. All columns and rows are kept."""
    model = default_model()
    names, counted = docs.columns, "n_chars" in docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [mask(t, found) for t, (_, found) in zip(texts, all_spans(texts, model), strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if counted:
                i = names.index("n_chars")
                old = cols[i].to_pylist()
                cols[i] = pa.array([o if t == u or u is None else len(u) for o, t, u in zip(old, texts, new, strict=True)], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
