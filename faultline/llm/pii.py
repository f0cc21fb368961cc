"""Personal data by rules and by gradient-boosted trees over candidate spans.

Rules find well-formed e-mail addresses, IPv4 addresses, card numbers and international phone numbers. Beside
them, generators with high recall propose overlapping spans in looser forms; boosted trees score each from its
format and its context, a threshold calibrated for each generator on held-out examples selects redactions, and of
overlapping selections the best stays. The trees are fitted on synthetic examples made from a seed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARE = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.I)
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: the longest run of local characters before an @ that a host with a dot follows."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at) if start < at else None
        last = host.end() if host else at + 1
        if host:
            yield start, last
        at = text.find("@", last)


def rules(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# Generators: kind, pattern. Each quantifier is bounded, so a long run of one character costs a constant a place.
GENERATORS = (
    ("tel", re.compile(r"(?<![0-9A-Za-z])[(+]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")),
    ("ipv6", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("mail", re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64} ?[(\[{] ?(?:at|@) ?[)\]}] ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}| ?[(\[{] ?dot ?[)\]}] ?[A-Za-z0-9-]{1,63}){1,4}", re.I)),
)
CUES = (
    ("tel", "phone", "call", "mobile", "fax", "cell", "whatsapp"),
    ("ssn", "social", "insurance", "tax", "passport", "national"),
    ("iban", "account", "bank", "bic", "transfer", "payment"),
    ("mail", "contact", "write", "reach", "address"),
    ("version", "order", "invoice", "isbn", "ref", "page", "line", "build", "date", "price", "ticket", "sku", "total"),
)
WORD = re.compile(r"[A-Za-z]+")


def describe(text: str, start: int, end: int, generator: int) -> list[float]:
    """Format and context of one span."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 8]
    digits = NOT_DIGIT.sub("", span)
    groups = re.findall(r"[0-9]+", span)
    words = {w.lower() for w in WORD.findall(before)}
    return [
        float(generator),
        float(len(span)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(span.count("-")),
        float(span.count(" ")),
        float(span.count(".")),
        float(span.count("/")),
        float("(" in span) + 2 * float(span.startswith("+")),
        sum(c.isalpha() for c in span) / max(1, len(span)),
        len(set(digits)) / max(1, len(digits)),
        float(luhn(digits)) if len(digits) > 1 else 0.0,
        float(bool(re.match(r"(19|20)[0-9]{2}[-/. ]", span))),
        float(len(set(span.lower().split(":"))) if generator == 3 else 0),
        float(bool(before[-1:].strip()) and before[-1:] not in "([{\"'=:"),
        float(after[:1] not in ("", " ", ".", ",", ";", ")", "\n", '"', "'", "]", "!", "?")),
        *(float(bool(words & set(c))) for c in CUES),
    ]


def propose(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of all candidates; they may overlap."""
    return [(m.start(), m.end(), g) for g, (_, pattern) in enumerate(GENERATORS) for m in pattern.finditer(text)]


@dataclass
class Trees:
    """Trees of depth three as arrays: 7 splits and 8 leaves each."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    thresholds: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            total += leaf[node - 7]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 50, rate: float = 0.3, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss with quantile cuts."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 18)[:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T)], axis=1)
    total, trees = np.zeros(len(x)), ([], [], [])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        feature, cut = np.zeros(7, dtype=np.int64), np.full(7, np.inf)
        for k in range(7):
            rows = node == k
            best = 1e-9
            for f, edges in enumerate(cuts):
                gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges) + 1))
                hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                if len(gain) and gain.max() > best:
                    best, feature[k], cut[k] = gain.max(), f, edges[gain.argmax()]
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
        leaf = rate * np.bincount(node - 7, g, 8) / (np.bincount(node - 7, h, 8) + ridge)
        total += leaf[node - 7]
        for column, value in zip(trees, (feature, cut, leaf)):
            column.append(value)
    return Trees(*(np.array(t) for t in trees), np.full(len(GENERATORS), 0.5))


def examples(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): one labelled span in each synthetic sentence."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick("abcdefghilmnoprstuvw") for _ in range(int(rng.integers(2, 9))))
    hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(pick("ABCDEFGHKLMNPRST") for _ in range(k))
    year = lambda: str(rng.integers(1980, 2030))
    forms = (
        (1, 0, lambda: f"({num(3)}) {num(3)}-{num(4)}"), (1, 0, lambda: f"{num(3)}-{num(3)}-{num(4)}"), (1, 0, lambda: f"{num(3)}.{num(3)}.{num(4)}"),
        (1, 0, lambda: f"0{num(2)} {num(3)} {num(2)} {num(2)}"), (1, 0, lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"), (1, 0, lambda: f"00{num(2)} {num(3)} {num(6)}"),
        (1, 1, lambda: f"{num(3)}-{num(2)}-{num(4)}"), (1, 2, lambda: f"{upper(2)}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}"), (1, 2, lambda: f"{upper(2)}{num(18)}"),
        (1, 3, lambda: ":".join(hexa(4) for _ in range(8))), (1, 3, lambda: "2001:db8:" + ":".join(hexa(int(rng.integers(1, 5))) for _ in range(6))),
        (1, 4, lambda: f"{word()}.{word()} (at) {word()} (dot) com"), (1, 4, lambda: f"{word()}{num(2)} [at] {word()}.org"), (1, 4, lambda: f"{word()}{{at}}{word()}{{dot}}net"),
        (0, 4, lambda: f"{word()} (at) {num(1)}.{num(1)}"), (0, 4, lambda: f"{word()} [at] {num(2)}.{num(3)}"),
        (0, 4, lambda: f"{num(3)} (at) {num(3)}.{num(2)}"),
        (0, 0, lambda: f"{year()}-{num(2)}-{num(2)} {num(2)}"), (0, 0, lambda: f"{num(2)}/{num(2)}/{year()}"), (0, 0, lambda: num(int(rng.integers(7, 16)))),
        (0, 0, lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}"), (0, 0, lambda: f"{num(1)}.{num(2)}.{num(3)}.{num(2)}"), (0, 0, lambda: " ".join(num(1) for _ in range(9))),
        (0, 0, lambda: f"{num(4)} {num(4)} {num(4)}"), (0, 0, lambda: f"{num(5)}.{num(6)}"), (0, 0, lambda: f"{year()} - {year()}"), (0, 0, lambda: f"{num(2)}.{num(2)}.{year()}"),
        (0, 0, lambda: " ".join(num(2) for _ in range(int(rng.integers(4, 8))))), (0, 0, lambda: f"{num(3)}/{num(3)}/{num(3)}"),
        (0, 2, lambda: f"{upper(2)}{num(2)}{upper(12)}"), (0, 2, lambda: f"{upper(2)}{num(2)} {upper(4)} {upper(4)} {upper(4)}"),
        (0, 3, lambda: ":".join(hexa(2) for _ in range(6))), (0, 3, lambda: ":".join(num(2) for _ in range(int(rng.integers(6, 8))))),
    )
    out = []
    while len(out) < n:
        label, generator, make = pick(forms)
        cue = rng.random()
        if generator == 1 or label == 0 and rng.random() < 0.2 and generator == 0:
            label, generator, make = pick(((1, 1, lambda: f"{num(3)}-{num(2)}-{num(4)}"), (0, 1, lambda: f"{num(3)} {num(2)} {num(4)}")))
        own = CUES[generator] if generator < 3 else CUES[3]
        lead = pick(own) if label and cue < 0.6 else pick(CUES[4]) if not label and cue < 0.6 else word()
        head = f"{' '.join(word() for _ in range(int(rng.integers(0, 5))))} {lead}{pick((': ', ' ', ' '))}"
        span = make()
        text = f"{head}{span}{pick((' ', '. ', ', ', chr(10)))}{word()}"
        got = [(s, e, g) for s, e, g in propose(text) if s < len(head) + len(span) and e > len(head)]
        out += [(text, s, e, int(label and s <= len(head) and e >= len(head) + len(span) and g == generator)) + (g,) for s, e, g in got]
    return out


@cache
def model() -> Trees:
    train, held = examples(6000, 1), examples(3000, 2)
    parts = [(np.array([describe(t, s, e, g) for t, s, e, _, g in rows]), np.array([r[3] for r in rows])) for rows in (train, held)]
    trees = boost(*parts[0])
    x, y = parts[1]
    scores = trees.score(x)
    for g in range(len(GENERATORS)):
        mine = x[:, 0] == g
        order = np.argsort(-scores[mine])
        precision = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(precision >= 0.98)
        trees.thresholds[g] = max(0.5, scores[mine][order][good[-1]]) if len(good) else math.inf
    return trees


def find(text: str, trees: Trees) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans), each as (start, kind, end) in order."""
    if not CARE.search(text):
        return [], []
    base = [(s, KINDS[k], e) for s, k, e in rules(text)]
    kept = sorted((s, e) for s, _, e in base)
    free = _clear(kept, proposals := propose(text)) if text else []
    added = []
    if free:
        x = np.array([describe(text, *proposals[i]) for i in free])
        p = trees.score(x)
        held: list[tuple[int, int]] = []
        for k in np.lexsort((x[:, 0], [proposals[i][0] for i in free], -p)):
            start, end, g = proposals[free[k]]
            if p[k] < trees.thresholds[g]:
                continue
            at = bisect_left(held, (start, end))
            if (at == 0 or held[at - 1][1] <= start) and (at == len(held) or held[at][0] >= end):
                held.insert(at, (start, end))
                added.append((start, GENERATORS[g][0], end))
    order = {k: i for i, k in enumerate((*KINDS, *(k for k, _ in GENERATORS)))}
    return base, sorted(base + added, key=lambda r: (r[0], order[r[1]]))


def _clear(kept: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Places of the spans that touch none of the kept ones, whose ends are not in order where they overlap."""
    starts = [s for s, _ in kept]
    ends = list(np.maximum.accumulate([e for _, e in kept])) if kept else []
    out = []
    for i, (start, end, _) in enumerate(spans):
        k = bisect_left(starts, end)
        if k == 0 or ends[k - 1] <= start:
            out.append(i)
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans[, redacted]); base and spans are "kind:start:end,...".

    Offsets are code points, ends exclusive. Null and empty texts have no spans. One row for each input row, also
    where ids repeat or are null. A very long text is searched whole by one task, which holds its spans. Other columns are
    ignored. redacted is the text with each union of overlapping
    spans replaced by its first kind in brackets.
    """
    trees = model()
    names = ["id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"] + ["redacted"] * redact
    types = [pa.int64()] * 5 + [pa.string()] * (2 + redact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda rows: ",".join(f"{k}:{s}:{e}" for s, k, e in rows)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                base, every = find(text, trees)
                row = [doc, *(sum(k == kind for _, k, _ in base) for kind in KINDS), show(base), show(every)]
                for column, cell in zip(out, row + [redacted(text, every)] * redact):
                    column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string" + ", redacted string" * redact)


def redacted(text: str, found: list[tuple[int, str, int]]) -> str:
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
