"""Personal data by fixed patterns, and by a skip-chain conditional random field for what they cut wrongly.

The field's nodes are atoms: runs of ASCII letters, digits and ``._%+@()-`` with a digit or ``@``; any other word is outside
of all spans, so the chain of a document falls into its runs of neighbouring atoms.  Equal atoms, and similar ones (same
mail host, same first three parts of an address, same first six of many digits), are linked to their next occurrence in
the document, however far; the links' potentials are shared, and loopy sum-product messages over chain and links, always
``PASSES`` of them, make labels agree.  Labels are outside, or first or further atom of a kind.

Weights are learned from the documents' own pattern spans, in at most about ``DOCS`` documents of at most ``ATOMS`` atoms,
which a hash of the rows draws.  Atoms of a match that swallowed its neighbours (digits of too many numbers in a row) are
left out there, as nobody knows their labels.  A span that the field adds touches no pattern span and passes an exact
check: sixteen to nineteen digits with their check digit, four parts up to 255, eight to fifteen digits, a mail address.

Defined cases: a null text is empty; a text without a digit or ``@`` has no spans; very long texts are read whole, and no
pattern takes more than linear time; repeated rows have a row each; rows with a null id are kept; other columns are ignored
by ``detect`` and kept by ``masked``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflux.llm._common import fresh

KINDS = ["email", "ip", "card", "phone"]
#: Documents and atoms of a document that the field is fitted on, at most (the first is an expectation).
DOCS, ATOMS = 2000, 400
#: Message passes, steps of the fit, its penalty on squared weights, and the belief from which an atom is of a kind.
PASSES, STEPS, PENALTY, LEAST = 20, 150, 0.02, 0.5
#: Edges whose messages are worked out at a time, and atoms from which on a batch's documents are labelled without the next ones.
EDGES, BATCH = 1 << 14, 1 << 16
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_ATOM = _LOCAL | frozenset("@()")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@][A-Za-z0-9._%+@()-]*+")
_HINT = re.compile(r"[0-9@]")
_NEAR = re.compile(r"[^\w\n]{0,3}")
_SEVEN = re.compile(r"[0-9]{3}-[0-9]{4}")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    twice = [(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def is_card(digits: str) -> bool:
    return 16 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return len(parts) == 4 and all(len(p) < 4 and int(p or 0) < 256 for p in parts)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Matches of the mail pattern, found from each @ outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
        end = max(end, text.rfind("@", end, max(at, 0)) + 1)
    return out


def patterns(text: str) -> list[list[Span]]:
    """Spans of the fixed patterns, for each kind in order of start."""
    found: list[list[Span]] = [[], [], [], []]
    if not _HINT.search(text):
        return found
    found[0] = emails(text)
    found[1] = [m.span() for m in _IP.finditer(text) if is_ip(m.group())]
    found[2] = [m.span() for m in _CARD.finditer(text) if is_card(_digits(m.group()))]
    found[3] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return found


def atoms(text: str) -> list[Span]:
    """Runs of atom characters with a digit or @, without what only ends a sentence or a bracket."""
    out, last = [], 0
    for m in _HIT.finditer(text):
        start, end = m.span()
        while start > last and text[start - 1] in _ATOM:
            start -= 1
        last = end
        while start < end and text[start] in "._%-()":
            start += 1
        while end > start and text[end - 1] in "._%-+()":
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def _size(n: int) -> int:
    """Class of a number of digits."""
    return sum(n >= least for least in (1, 4, 7, 8, 12, 16, 20))


def features(text: str, span: Span) -> list[bool]:
    a, b = span
    s, before, after = text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]
    digits = _digits(s)
    letters = any(c.isalpha() for c in s)
    local, at, host = s.partition("@")
    parts = s.split(".")
    dotted = len(parts) == 4 and all(p.isdigit() for p in parts)
    size = _size(len(digits))
    return [
        True, *[size == k for k in range(8)], bool(at), bool(at) and bool(local) and "." in host, s.count("@") > 1, letters and not at, len(s) >= 24 and letters and not at, digits == s,
        16 <= len(digits) <= 19 and digits == s and luhn(digits), 16 <= len(digits) <= 19 and not luhn(digits), dotted, dotted and is_ip(s), s.startswith("+"), "-" in s, bool(_SEVEN.fullmatch(s)),
        before == "(", after == ")", before in ('"', "'", "="), "." in s and not dotted,
    ]


FEATURES = len(features("1", (0, 1)))
LABELS = 1 + 2 * len(KINDS)


def _alike(s: str) -> tuple[str, str]:
    """Keys by which an atom is equal, and similar, to others; empty where there is none."""
    digits, low = _digits(s), s.lower()
    if "@" in s:
        return low, "@" + low.partition("@")[2]
    if s.count(".") == 3:
        return low, s.rpartition(".")[0]
    if len(digits) >= 7:
        return digits, digits[:6] if len(digits) >= 12 else ""
    return (low if len(low) > 2 else ""), ""


def graph(text: str, found: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """(features as bits, edges as rows of two atoms and a kind: 0 chain, 1 equal, 2 similar) of a document's atoms."""
    bits = np.array([sum(1 << k for k, on in enumerate(features(text, s)) if on) for s in found], dtype=np.int64)
    edges = [(i - 1, i, 0) for i in range(1, len(found)) if _NEAR.fullmatch(text, found[i - 1][1], found[i][0])]
    last: dict[tuple[int, str], int] = {}
    for i, (a, b) in enumerate(found):
        for kind, key in enumerate(_alike(text[a:b]), 1):
            if key:
                j = last.get((kind, key))
                if j is not None:
                    edges.append((j, i, kind))
                last[kind, key] = i
    return bits, np.array(edges, dtype=np.int64).reshape(-1, 3)


def silver(text: str, found: list[Span]) -> np.ndarray:
    """Label of each atom by the fixed patterns; -1 where a match swallowed several numbers and failed."""
    label = np.zeros(len(found), dtype=np.int64)
    starts, ends = np.array(found, dtype=np.int64).reshape(-1, 2).T
    for kind, spans in enumerate(patterns(text)):
        for a, b in spans:
            inside = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b))
            inside = inside[label[inside] == 0]
            label[inside] = 2 + 2 * kind
            label[inside[:1]] = 1 + 2 * kind
    for m in _CARD.finditer(text):
        if not is_card(_digits(m.group())):
            inside = np.arange(np.searchsorted(starts, m.start()), np.searchsorted(starts, m.end()))
            if len(inside) > 1 and len(_digits(m.group())) > 15:
                label[inside[label[inside] == 0]] = -1
    return label


class Field:
    """Weights of the field: features by label, and one table of label pairs for chain, equal and similar links."""

    def __init__(self) -> None:
        self.nodes, self.pairs = np.zeros((FEATURES, LABELS)), np.zeros((3, LABELS, LABELS))

    def beliefs(self, on: np.ndarray, edges: np.ndarray, passes: int = PASSES, of_edges: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Beliefs of nodes and edges after so many passes of damped messages along all edges at once."""
        own = on @ self.nodes
        i, j, kind = edges.T
        forth, back = np.zeros((len(edges), LABELS)), np.zeros((len(edges), LABELS))
        for _ in range(passes if len(edges) else 0):
            total = own + _gathered(len(own), i, j, forth, back)
            forth, back = (forth + _message(total[i] - back, self.pairs, kind)) / 2, (back + _message(total[j] - forth, self.pairs.transpose(0, 2, 1), kind)) / 2
        total = own + _gathered(len(own), i, j, forth, back)
        if not of_edges:
            return _soft(total), None
        both = (total[i] - back)[:, :, None] + (total[j] - forth)[:, None, :] + self.pairs[kind]
        return _soft(total), _soft(both.reshape(len(edges), both.shape[1] * both.shape[2])).reshape(both.shape)

    def fit(self, on: np.ndarray, label: np.ndarray, edges: np.ndarray, steps: int = STEPS) -> Field:
        """Climb the penalised likelihood: gradients are observed less believed counts, steps of each weight its own size."""
        n = max(1, len(on))
        seen, pairs = on.T @ np.eye(LABELS)[label], np.zeros_like(self.pairs)
        np.add.at(pairs, (edges[:, 2], label[edges[:, 0]], label[edges[:, 1]]), 1.0)
        moment, spread = [0.0, 0.0], [0.0, 0.0]
        for step in range(1, steps + 1):
            belief, both = self.beliefs(on, edges, PASSES // 2)
            expected = np.zeros_like(self.pairs)
            np.add.at(expected, edges[:, 2], both)
            for k, (weight, slope) in enumerate(((self.nodes, seen - on.T @ belief), (self.pairs, pairs - expected))):
                slope = slope - PENALTY * weight
                moment[k], spread[k] = 0.9 * moment[k] + 0.1 * slope, 0.99 * spread[k] + 0.01 * slope**2
                weight += 0.2 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-3 * n**0.5)
        return self


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf))
    return e / e.sum(axis=1, keepdims=True)


def _message(pre: np.ndarray, tables: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Messages over edges, so many edges at a time as memory bears."""
    sent = np.empty_like(pre)
    for at in range(0, len(pre), EDGES):
        x = pre[at : at + EDGES, :, None] + tables[kind[at : at + EDGES]]
        top = x.max(axis=1)
        out = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        sent[at : at + EDGES] = out - out.max(axis=1, keepdims=True)
    return sent


def _gathered(n: int, i: np.ndarray, j: np.ndarray, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Sum of the messages that come to each node."""
    at = np.r_[j, i]
    return np.stack([np.bincount(at, np.r_[forth[:, k], back[:, k]], n) for k in range(LABELS)], axis=1)


def _on(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(FEATURES) & 1).astype(np.float64)


def _valid(kind: int, text: str) -> bool:
    digits = _digits(text)
    checks = (lambda: len(emails(text)) == 1, lambda: is_ip(text) if re.fullmatch(r"[0-9.]+", text) else False, lambda: is_card(digits) and not any(c.isalpha() for c in text), lambda: 8 <= len(digits) <= 15 and not any(c.isalpha() or c == "@" for c in text))
    return checks[kind]()


def label_spans(field: Field, texts: list[str]) -> Iterator[list[list[Span]]]:
    """Spans that the field finds in each text, for each kind; the graphs of many texts are passed over at once."""
    parts, offset = [], 0
    for text in texts:
        found = atoms(text) if _HINT.search(text) else []
        bits, edges = graph(text, found) if found else (np.zeros(0, dtype=np.int64), np.zeros((0, 3), dtype=np.int64))
        parts.append((text, found, bits, edges + [offset, offset, 0], offset))
        offset += len(found)
        if offset >= BATCH:
            yield from _labelled(field, parts)
            parts, offset = [], 0
    if parts:
        yield from _labelled(field, parts)


def _labelled(field: Field, parts: list[tuple]) -> Iterator[list[list[Span]]]:
    """Spans of texts of which each has its atoms, features, edges and the number of its first node."""
    belief, _ = field.beliefs(_on(np.concatenate([p[2] for p in parts])), np.concatenate([p[3] for p in parts]), of_edges=False)
    for text, found, _bits, edges, first in parts:
        spans: list[list[Span]] = [[], [], [], []]
        kinds = belief[first : first + len(found), 1:].reshape(len(found), len(KINDS), 2)
        linked = set((edges[edges[:, 2] == 0, 1] - first).tolist())
        best, sure = kinds.sum(axis=2).argmax(axis=1) if len(found) else [], kinds.sum(axis=2).max(axis=1, initial=0) >= LEAST
        at = 0
        while at < len(found):
            kind, stop = int(best[at]), at + 1
            if not sure[at]:
                at += 1
                continue
            while stop < len(found) and stop in linked and sure[stop] and best[stop] == kind and kinds[stop, kind, 1] > kinds[stop, kind, 0]:
                stop += 1
            span = (found[at][0], found[stop - 1][1])
            if _valid(kind, text[span[0] : span[1]]):
                spans[kind].append(span)
            at = stop
        yield spans


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of ``spans`` that touch none of ``taken``; both are in order and each without overlaps of its own kind."""
    if not spans or not taken:
        return spans
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate([b for _, b in taken])
    before = np.searchsorted(starts, [b for _, b in spans])
    return [s for s, k in zip(spans, before) if k == 0 or ends[k - 1] <= s[0]]


def all_spans(field: Field, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, by a pattern) of each text, by kind and start."""
    out = []
    for text, added in zip(texts, label_spans(field, texts)):
        base = patterns(text)
        taken = sorted(s for spans in base for s in spans)
        out.append([x for kind, own, more in zip(KINDS, base, added) for x in sorted([(kind, *s, True) for s in own] + [(kind, *s, False) for s in _free(more, taken)], key=lambda x: x[1])])
    return out


def learn(docs: DataFrame) -> Field:
    """Fit the field on the drawn documents; without any it adds nothing."""
    field = Field()
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, DOCS / max(1, text.count()))
    drawn = text.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for s in df["text"]:
                found = atoms(s)
                if 0 < len(found) <= ATOMS:
                    bits, edges = graph(s, found)
                    rows.append((bits.tolist(), silver(s, found).tolist(), edges.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["bits", "label", "edges"])

    drawn_rows = drawn.mapInPandas(run, "bits array<long>, label array<long>, edges array<long>").toPandas()
    parts, offset = [], 0
    for bits, label, edges in sorted((tuple(a), tuple(b), tuple(c)) for a, b, c in drawn_rows.itertuples(index=False)):
        known = np.asarray(label) >= 0
        moved = np.cumsum(known) - 1 + offset
        e = np.asarray(edges, dtype=np.int64).reshape(-1, 3)
        e = e[known[e[:, 0]] & known[e[:, 1]]] if len(e) else e
        parts.append((np.asarray(bits, dtype=np.int64)[known], np.asarray(label)[known], np.c_[moved[e[:, 0]], moved[e[:, 1]], e[:, 2]]))
        offset += int(known.sum())
    if offset:
        bits, label, edges = (np.concatenate(x) for x in zip(*parts))
        field.fit(_on(bits), label, edges.astype(np.int64))
    return field


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans) of every document: kind, start, end in code points, and whether a fixed pattern has it."""
    field = field or learn(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = all_spans(field, df["text"].tolist()) if len(df) else []
            yield pd.DataFrame({"doc_id": df["doc_id"].astype("Int64"), "spans": [[{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in x] for x in found]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(run, f"doc_id long, spans {SPANS}")


def masked(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with each span of their text replaced by its kind in brackets; where spans overlap, the first is replaced."""
    field = field or learn(docs)
    hidden = fresh(docs, "_text")

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, all_spans(field, texts.fillna("").tolist())):
            if text is not None:
                done, last = [], 0
                for kind, a, b, _own in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= last:
                        done += [text[last:a], f"[{kind}]"]
                        last = b
                text = "".join([*done, text[last:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(hidden, hide("text")).select(*[F.col(hidden).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (by the patterns), base_sha256, spans, n_added."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return detect(docs).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    )
