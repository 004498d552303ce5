"""Personal data by a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns and always stay.  The field adds spans: its
nodes are the base matches and the other tokens of a text that hold a digit or an at sign, digit groups that
single spaces separate being one token; texts without base matches are judged, too.  Neighbouring
nodes share a chain potential; distant nodes that are alike share skip potentials: by the same last seven
digits, the same network address (whatever its port), or the same local part of a mail address (whatever its
case, its dots and dashes, and what follows a plus sign).  So a number written out once as a phone number is
labelled as one wherever it is repeated in another form.  Base matches are observed; the labels of the
other nodes come from loopy belief propagation.  A node labelled as an entity becomes an added span.

Repeats of one key are linked through a hub variable, the label of that value in the document, so m repeats
make m edges.  The hub of a base match is observed like the match itself.  The weights (shape and cue features
by label, chain and skip agreement) are learned by regularised pseudo-likelihood from the nodes of a sample of
at most TRAIN_DOCS documents, TEXT_NODES nodes a text and TRAIN_NODES in all, all taken by hash; whether a
pattern matched is never a feature, a checksum that fails is.  The scans are linear in the text: each pattern is matched from its rarest character.

Defined results: null texts are empty; repeated rows give repeated results; a null doc_id is passed
through and is not trained on; without training data the added spans come from agreement alone; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.runtime import configure, spread

# The kinds in the order in which they sort, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[0-9@]\S*+")
GROUPS = re.compile(r"[+(]*[0-9][0-9().+-]*\Z")
ADDRESS = re.compile(r"([0-9]+(?:\.[0-9]+){3})(?::[0-9]+)?\Z")
RUN_DIGITS = 19
CUES = {"email": ("mail", "contact", "@"), "ip": ("ip", "host", "addr", "server"), "card": ("card", "visa", "credit", "iban", "account"), "phone": ("phone", "tel", "call", "fax", "mobile")}

#: Bounds of the training sample: documents, nodes of one text, nodes in all.
TRAIN_DOCS = 20_000
TEXT_NODES = 1000
TRAIN_NODES = 200_000
ROUNDS = 20
TIE = 7
N_SHAPE = 22


# -- base spans ------------------------------------------------------------------------------------


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign: the local part is the run of its characters before it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = at = found.end()
        else:
            done = at = at + 1


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = [(p.start() + m.start(), p.end() + m.start(), p.group()) for p in re.finditer(r"[0-9]+", m.group())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for _, _, p in four):
                yield four[0][0], four[3][1]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() > 38:
            continue
        digits = re.sub(r"[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(DIGIT.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all base matches, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(a, 1, b) for a, b in ips(text)]
        out += [(a, 2, b) for a, b in cards(text)]
        out += [(a, 3, b) for a, b in phones(text)] if "+" in text else []
    return sorted(out)


# -- the field -------------------------------------------------------------------------------------


class Node(NamedTuple):
    start: int
    end: int
    label: int  # -1 where it is not observed
    shape: tuple[float, ...]
    key: str
    barred: tuple[int, ...] = ()  # labels that its checksum or its number ranges rule out


def _shape(text: str, start: int, end: int) -> tuple[float, ...]:
    """Features of a stretch of text that say nothing of which pattern matched it."""
    own = text[start:end]
    digits = sum(c.isdigit() for c in own)
    letters = sum(c.isalpha() for c in own)
    before = text[max(0, start - 24) : start].lower()
    cues = [float(any(w in before for w in CUES[k])) for k in KINDS]
    size = [float(lo <= digits <= hi) for lo, hi in ((0, 0), (1, 3), (4, 6), (7, 9), (10, 13), (14, 19), (20, 10**9))]
    plain = re.sub(r"[^0-9]", "", own)
    long = 14 <= len(plain) <= 19
    checks = [float(long and luhn(plain)), float(long and not luhn(plain))]
    marks = [float("@" in own), float(own.count(".") == 3), float("-" in own or " " in own), float(own.startswith("+")), float("(" in own), float("%" in own or "$" in own or ":" in own)]
    return (1.0, *cues, *size, *marks, *checks, float(letters > 0), float(letters > digits))


def _key(own: str) -> str:
    """What repeats of a value have in common; '' for tokens that say too little."""
    if "@" in own:
        local = own[: own.index("@")].lower().strip("<(\"'.,;:").split("+")[0]
        return "@" + re.sub(r"[._-]", "", local)
    address = ADDRESS.match(own)
    if address:
        return "ip" + ".".join(p.lstrip("0") or "0" for p in address[1].split("."))
    digits = re.sub(r"[^0-9]", "", own)
    return digits[-TIE:] if len(digits) >= TIE else ""


def _barred(own: str) -> tuple[int, ...]:
    digits = re.sub(r"[^0-9]", "", own)
    card = 14 <= len(digits) <= 19 and not luhn(digits)
    parts = own.split(".")
    ip = len(parts) == 4 and all(p.isdigit() for p in parts) and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in parts)
    return (3,) * card + (2,) * ip


def _digits(own: str) -> str:
    return re.sub(r"[^0-9]", "", own)


def joined(text: str, tokens: list[tuple[int, int]], known: set[str]) -> list[tuple[int, int]]:
    """The tokens, with digit groups that single spaces (and brackets or dots at them) separate joined to one number.

    A run of up to RUN_DIGITS digits is one number.  In a longer one (a table, say) the groups that end as a
    known number does, and only those, are joined.
    """
    runs: list[list[tuple[int, int]]] = []
    out = []
    for a, b in tokens:
        if not GROUPS.match(text[a:b]):
            out.append((a, b))
        elif runs and text[runs[-1][-1][1] : a] in (" ", ") "):
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    tails: dict[str, list[str]] = {}
    for k in known:
        if len(k) >= TIE:
            tails.setdefault(k[-TIE:], []).append(k)
    for run in runs:
        groups = [_digits(text[a:b]) for a, b in run]
        if len(run) > 1 and TIE <= sum(map(len, groups)) <= RUN_DIGITS:
            out.append((run[0][0], run[-1][1]))
            continue
        e = len(run)
        while e > 0:
            best, digits = e - 1, ""
            for s in range(e - 1, -1, -1):
                digits = groups[s] + digits
                if len(digits) > RUN_DIGITS:
                    break
                if len(digits) >= TIE and any(k.endswith(digits) for k in tails.get(digits[-TIE:], ())):
                    best = s
            out.append((run[best][0], run[e - 1][1]))
            e = best
    return out


def nodes_of(text: str, spans: list[tuple[int, int, int]]) -> list[Node]:
    """Base matches (of overlapping ones the first) and the other tokens with digits or at signs, in order."""
    covered: list[tuple[int, int, int]] = []
    for s in spans:
        if not covered or s[0] >= covered[-1][2]:
            covered.append(s)
    found = [(a, b, k + 1) for a, k, b in covered]
    free = []
    ends = iter(covered + [(len(text) + 1, 0, len(text) + 1)])
    now, last = next(ends), 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while a > last and not text[a - 1].isspace():
            a -= 1
        last = b
        while now[2] <= a:
            now = next(ends)
        if now[0] < b:
            continue
        while a < b and not text[a].isalnum() and text[a] not in "+(":
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            free.append((a, b))
    found += [(a, b, -1) for a, b in joined(text, free, {_digits(text[a:b]) for a, k, b in covered if k > 1})]
    found.sort()
    return [Node(a, b, k, _shape(text, a, b), _key(text[a:b]), _barred(text[a:b]) if k < 0 else ()) for a, b, k in found]


class Field:
    """Weights: shape features by label, and agreement along the chain and across skips."""

    def __init__(self, unary: np.ndarray, chain: float, skip: float):
        self.unary, self.chain, self.skip = unary, chain, skip


def default_field() -> Field:
    unary = np.zeros((N_SHAPE, len(LABELS)))
    unary[0, 0] = 1.0
    return Field(unary, 0.1, 2.0)


def links_of(nodes: list[Node], near: int = 40) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Chain edges between neighbours close to each other; groups of two nodes or more with one key."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end <= near]
    groups: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        if n.key:
            groups.setdefault(n.key, []).append(i)
    return chain, [g for g in groups.values() if len(g) > 1]


def beliefs(nodes: list[Node], field: Field) -> np.ndarray:
    """Marginals by loopy sum-product; groups with one key are joined through a hub variable."""
    chain, groups = links_of(nodes)
    n, k = len(nodes), len(LABELS)
    unary = np.array([x.shape for x in nodes]) @ field.unary
    for i, x in enumerate(nodes):
        if x.label >= 0:
            unary[i] = -50.0
            unary[i, x.label] = 50.0
        unary[i, list(x.barred)] = -50.0
    edges = [(a, b, field.chain) for a, b in chain]
    for h, g in enumerate(groups):
        edges += [(i, n + h, field.skip) for i in g]
    hubs = np.zeros((len(groups), k))
    for h, g in enumerate(groups):
        for i in g:  # an observed hub: no number of repeats without evidence of their own changes it
            if nodes[i].label >= 0:
                hubs[h, nodes[i].label] = 1e9
    local = np.vstack([unary, hubs])
    if edges:
        a, b = (np.array([e[j] for e in edges]) for j in (0, 1))
        w = np.array([e[2] for e in edges])[:, None]
        source, target, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        sent = np.zeros((len(source), k))
        for _ in range(ROUNDS):
            total = local.copy()
            np.add.at(total, target, sent)
            out = total[source] - sent[back]
            # agreement adds its weight on the diagonal: log(sum exp(out) + (e^w - 1) exp(out_label))
            out -= out.max(axis=1, keepdims=True)
            soft = np.exp(out)
            fresh = np.log(soft.sum(axis=1, keepdims=True) + np.expm1(weight) * soft)
            fresh -= fresh.max(axis=1, keepdims=True)
            done = np.abs(fresh - sent).max() < 1e-6
            sent = 0.5 * sent + 0.5 * fresh
            if done:
                break
        total = local.copy()
        np.add.at(total, target, sent)
    else:
        total = local
    own = total[:n] - total[:n].max(axis=1, keepdims=True)
    return np.exp(own) / np.exp(own).sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    nodes = nodes_of(text, spans)
    if not any(x.label < 0 for x in nodes):
        return []
    best = beliefs(nodes, field).argmax(axis=1)
    return [(x.start, int(b) - 1, x.end) for x, b in zip(nodes, best, strict=True) if x.label < 0 and b > 0]


# -- training --------------------------------------------------------------------------------------


def training_rows(text: str) -> list[list[float]]:
    """Per node: shape, neighbours' and twins' labels as counts, own label; tokens outside matches are none."""
    nodes = nodes_of(text, base_spans(text))
    chain, groups = links_of(nodes)
    label = [max(x.label, 0) for x in nodes]
    around, twins = np.zeros((len(nodes), len(LABELS))), np.zeros((len(nodes), len(LABELS)))
    for a, b in chain:
        around[a, label[b]] += 1
        around[b, label[a]] += 1
    for g in groups:
        total = np.bincount([label[i] for i in g], minlength=len(LABELS))
        for i in g:
            rest = total.copy()
            rest[label[i]] -= 1
            twins[i] += rest / rest.sum()
    return [[*x.shape, *around[i], *twins[i], float(label[i])] for i, x in enumerate(nodes)]


def fit(rows: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Pseudo-likelihood: multinomial logistic regression with shared weights for agreement."""
    if not len(rows) or len(np.unique(rows[:, -1])) < 2:
        return default_field()
    k = len(LABELS)
    x, around, twins, y = rows[:, :N_SHAPE], rows[:, N_SHAPE : N_SHAPE + k], rows[:, N_SHAPE + k : N_SHAPE + 2 * k], rows[:, -1].astype(int)
    truth = np.eye(k)[y]
    unary, agree = np.zeros((N_SHAPE, k)), np.zeros(2)
    m = [np.zeros_like(unary), np.zeros(2)]
    v = [np.zeros_like(unary), np.zeros(2)]
    for t in range(1, steps + 1):
        z = x @ unary + agree[0] * around + agree[1] * twins
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = (p - truth) / len(y)
        grads = [x.T @ off + ridge * unary, np.array([(off * around).sum(), (off * twins).sum()]) + ridge * agree]
        for i, w in enumerate((unary, agree)):
            m[i] = 0.9 * m[i] + 0.1 * grads[i]
            v[i] = 0.999 * v[i] + 0.001 * grads[i] ** 2
            w -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Field(unary, float(max(agree[0], 0.0)), float(max(agree[1], 0.0)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on the base matches of at most about TRAIN_DOCS documents, taken by hash of the id."""
    configure(docs.sparkSession)
    share = int((1 << 30) * min(1.0, TRAIN_DOCS / max(1, docs.count())))
    some = spread(docs).where(F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1 << 30)) < share).select(F.col(text_col).cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0):
                found = training_rows(t.as_py())
                # of a text with more nodes, evenly spaced ones
                rows += found if len(found) <= TEXT_NODES else [found[i * len(found) // TEXT_NODES] for i in range(TEXT_NODES)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, type=pa.list_(pa.float64()))], names=["x"])

    made = some.mapInArrow(run, "x array<double>")
    # the first by hash are the same whatever the partitions; equal rows are interchangeable
    sample = made.orderBy(F.xxhash64(F.lit(7), "x"), "x").limit(TRAIN_NODES).toPandas()
    rows = np.array(sample["x"].tolist(), dtype=float).reshape(-1, N_SHAPE + 2 * len(LABELS) + 1)
    return fit(rows[np.lexsort(rows.T[::-1])])


# -- the operator ----------------------------------------------------------------------------------


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (of all) for every row."""
    configure(docs.sparkSession)
    field = field or train(docs, id_col, text_col)
    rows = spread(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value in b.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, field)
                held = spans_text(base)
                out.append((*(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(held.encode()).hexdigest(), spans_text(base + more), len(more), len(base) + len(more)))
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=t) for c, t in zip(cols, types, strict=True))], names=names)

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, {kinds}, base_sha256 string, spans string, n_added long, n_spans long")
