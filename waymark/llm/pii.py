"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans: e-mail addresses, IP addresses, payment cards and phone numbers.  The field
labels what else may be personal: tokens with a digit or an "@", and capitalised words that are part of an
address found in the document.  Its nodes are those tokens and, as evidence, the base spans.  Chain edges join
neighbours.  Skip edges join distant nodes of one document that repeat each other (equal letters and digits, or
equal to the part before an "@") or resemble each other (numbers that share their first or last digits or are
one edit apart, words of a local part).  Loopy sum-product messages carry labels along all edges, so that a
number written out once in full is also found where it is repeated without its prefix or with a typing error.
Base spans always stay; confident labels elsewhere add spans.

All potentials (token weights, chain and both skip tables) are learned together by pseudo-likelihood: each
token's label given its neighbours' labels.  The sample is ``SAMPLE`` documents, picked by hash.  Into those
with base spans, repeats of these are planted in shortened or misspelled form, and beside them unrelated
tokens of the same shapes, so that only the edges tell them apart.  At most ``SAMPLE_TOKENS`` tokens of a
document, drawn at random, count; everything else covers all tokens of whole texts.

Defined results: null texts are empty ones and have no spans; with no document to learn from, only
base spans are returned; repeated rows are judged alike; null doc_ids pass through; input columns
called like an output are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._common import lean, sampled, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_TOKENS, ROUNDS, SURE, EVIDENCE, DAMPING = 1500, 200, 12, 0.9, 40.0, 0.3
LABELS = 1 + len(KINDS)  # 0 is no personal data
FORM, WORD, NUMBERS, VIEWS, QUICK = 4, 4, range(7, 20), 4, 10  # shortest form and word, and how many digits are compared; plantings of a document

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT, TOKEN = re.compile("[0-9@]"), re.compile(r"\S+")
EDGE_SIGNS = ".,;:!?\"'()[]{}<>*#$%&"
PLAIN, LETTERS, AT = re.compile(r"[\W_]+"), re.compile(r"[^\W\d_]+"), re.compile(r"[\[({]at[\])}]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each "@" with the longest run before it, in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 and (len(p) <= 4 or not p[:-4].strip("0")) for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in NUMBER.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind, in order."""
    digits = re.search("[0-9]", text)
    return [
        emails(text) if "@" in text else [], addresses(text) if digits and "." in text else [],
        cards(text) if digits else [], phones(text) if digits and "+" in text else [],
    ]


FEATURES = 27


def _shape(token: str, before: str | None, after: str | None) -> list[float]:
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    core = token.strip(EDGE_SIGNS)
    out = [1.0, float("@" in token), float("+" in token)]
    out += [float(low <= digits <= high) for low, high in ((0, 0), (1, 1), (2, 3), (4, 6), (7, 8), (9, 12), (13, 19), (20, 1 << 30))]
    dots = core.count(".")
    out += [float(dots == k) for k in range(4)] + [float(dots > 3)]
    out += [float("-" in core), float("(" in token), float("_" in core or "%" in core), float("=" in core or "/" in core)]
    out += [float(letters == 0), float(0 < letters <= digits), float(letters > digits), float(core[:1].isalpha())]
    out += [float(before is not None), float(after is not None), float(len(core) > 24)]
    return out


def close(a: str, b: str) -> bool:
    """Whether one edit makes ``a`` of ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def keys(text: str) -> Iterator[tuple[str, bool]]:
    """What a node shares with those that repeat it (True) or may resemble it."""
    lowered = AT.sub("@", text.lower())
    local = lowered.partition("@")[0]
    for form in {PLAIN.sub("", lowered), PLAIN.sub("", local)}:
        if len(form) >= FORM:
            yield form, True
    if "@" in lowered or lowered.isalpha():
        for word in set(LETTERS.findall(local)):
            if len(word) >= WORD:
                yield "w" + word, False
    groups = re.findall("[0-9]+", local)
    if len(groups) >= 3 and max(map(len, groups)) <= 3:
        yield "i" + ".".join(groups[:3]), False
    digits = "".join(groups)
    if len(digits) in NUMBERS and not any(c.isalpha() for c in local):
        yield "s" + digits[-7:], False
        yield "f" + digits[:8], False
        for k in range(len(digits)):
            yield "e" + digits[:k] + digits[k + 1 :], False
        yield "e" + digits, False


def _before(text: str, start: int) -> str:
    """The last sign before ``start`` that is no blank, or nothing."""
    while start and text[start - 1] in " \t":
        start -= 1
    return text[start - 1 : start] if start else ""


@dataclass
class Graph:
    """The nodes of some texts: where they lie, their shapes, labels and edges; the base spans among them are evidence."""

    doc: list[int]
    span: list[tuple[int, int]]
    shape: list[list[float]]
    label: list[int]
    given: list[bool]
    chain: list[tuple[int, int]]
    same: list[tuple[int, int]]
    similar: list[tuple[int, int]]

    @staticmethod
    def empty() -> "Graph":
        return Graph([], [], [], [], [], [], [], [])

    def _nodes(self, text: str, base: list[list[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
        """(start, end, kind or 0) of base spans and of the tokens beside them, in turn."""
        marked = sorted((s, e, k + 1) for k, spans in enumerate(base) for s, e in spans)
        names = {w for s, e in base[0] for w in LETTERS.findall(text[s:e].partition("@")[0].lower()) if len(w) >= WORD}
        if names:  # a word that is also written small is no name
            ends = [0, *(e for _, e in base[0]), len(text)]
            rest = " ".join(text[e:s] for e, s in zip(ends, [*(s for s, _ in base[0]), len(text)], strict=False))
            names -= {w for w in LETTERS.findall(rest) if w.islower()}
        at, free = 0, 0
        for m in TOKEN.finditer(text):
            start, end = m.span()
            while at < len(marked) and marked[at][0] < end:
                if marked[at][0] >= free:
                    yield marked[at]
                    free = marked[at][1]
                at += 1
            if start < free:
                continue
            core = m[0].strip(EDGE_SIGNS)
            named = names and core.istitle() and core.lower() in names and _before(text, start) not in ("", ".", "!", "?", "\n", "\r")
            if HINT.search(m[0]) or named:
                yield start, end, 0

    def add(self, doc: int, text: str, base: list[list[tuple[int, int]]]) -> None:
        nodes = list(self._nodes(text, base))
        beside = [k > 0 and text[nodes[k - 1][1] : nodes[k][0]].strip(EDGE_SIGNS + " \t\r\n") == "" for k in range(len(nodes))] + [False]
        last: dict[str, tuple[int, int]] = {}  # of each key the last node, and the last evidence
        for k, (start, end, kind) in enumerate(nodes):
            token, node = text[start:end], len(self.doc)
            low = start + len(token) - len(token.lstrip(EDGE_SIGNS)) if not kind else start
            high = end - (len(token) - len(token.rstrip(EDGE_SIGNS))) if not kind else end
            self.doc.append(doc)
            self.span.append((low, high) if low < high else (start, end))
            self.shape.append(_shape(token, text[slice(*nodes[k - 1][:2])] if beside[k] else None, text[slice(*nodes[k + 1][:2])] if beside[k + 1] else None))
            self.label.append(kind)
            self.given.append(kind > 0)
            if beside[k]:
                self.chain.append((node - 1, node))
            # Each node is linked to the last ones before it that share a key: links grow with the tokens only.
            own = text[slice(*self.span[node])]
            found: dict[int, bool] = {}
            for key, equal in keys(own):
                before, evidence = last.get(key, (-1, -1))
                for other in {before, evidence} - {-1, node}:
                    if equal or key[0] != "e" or close(*("".join(c for c in text[slice(*self.span[j])] if c in "0123456789") for j in (other, node))):
                        found[other] = found.get(other, False) or equal
                last[key] = (node, node if kind else evidence)
            for other, equal in found.items():
                if not (beside[k] and other == node - 1) and not (kind and self.given[other]):
                    (self.same if equal else self.similar).append((other, node))


@dataclass(frozen=True)
class Field:
    """Token weights and edge potentials (log scale): chain from left to right, and both kinds of skip edges."""

    weights: np.ndarray
    chain: np.ndarray
    same: np.ndarray
    similar: np.ndarray

    def beliefs(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product over all graphs at once: the label probabilities of each node."""
        own = np.array(graph.shape) @ self.weights
        label, given = np.array(graph.label), np.flatnonzero(graph.given)
        own[given] = 0.0
        own[given, label[given]] = EVIDENCE
        kinds = ((graph.chain, self.chain), (graph.same, self.same), (graph.similar, self.similar))
        edges = np.array([e for own_edges, _ in kinds for e in own_edges], dtype=np.int64).reshape(-1, 2)
        factor = np.exp(np.concatenate([np.repeat(table[None], len(own_edges), 0) for own_edges, table in kinds]))
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        factor = np.concatenate([factor, factor.transpose(0, 2, 1)])
        n = len(edges)
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        message = np.zeros((2 * n, LABELS))
        for _ in range(rounds if n else 0):
            total = own.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            sent = np.log(np.maximum(np.einsum("ea,eab->eb", out, factor), 1e-30))
            sent -= sent.max(axis=1, keepdims=True)
            change = np.abs(sent - message).max()
            message = DAMPING * message + (1 - DAMPING) * sent
            if change < 1e-3:
                break
        total = own.copy()
        np.add.at(total, target, message)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def variant(kind: str, span: str, rng: random.Random) -> str:
    """A base span as it may be repeated: shortened, respaced or misspelled."""
    digits = "".join(c for c in span if c in "0123456789")
    if kind == "email":
        local, _, domain = span.partition("@")
        words = [w for w in re.findall(r"[A-Za-z]+", local) if len(w) >= WORD]
        return rng.choice([local, local + "@", f"{local}[at]{domain}", *(w.title() for w in words)])
    if kind == "ip":
        parts = span.split(".")
        return rng.choice(["-".join(parts), ".".join([*parts[:3], "x"]), ":".join(parts)])
    if kind == "phone" and rng.random() < 0.7:
        own = digits[-10:]
        return rng.choice([f"{own[:-7]}-{own[-7:-4]}-{own[-4:]}", f"{own[-7:-4]}-{own[-4:]}", own, digits, f"{own[:-7]}.{own[-7:-4]}.{own[-4:]}"])
    if kind == "card" and rng.random() < 0.3:
        return digits[: rng.randint(9, 12)]
    k = rng.randrange(len(digits))
    return digits[:k] + rng.choice([str(rng.randint(0, 9)), ""]) + digits[k + 1 :]


def planted(text: str, base: list[list[tuple[int, int]]], rng: random.Random, each: int = 3) -> tuple[str, list[tuple[int, int, int]]]:
    """``text`` with repeats of its base spans and unrelated tokens of like shape put in: (start, end, kind) of each, 0 if unrelated."""
    put = []
    for k, own in enumerate(base):
        for s, e in own[:each]:
            like = variant(KINDS[k], text[s:e], rng)
            put.append((like, k + 1))
            for _ in range(2):
                other = variant(KINDS[k], text[s:e], rng)
                other = "".join(str(rng.randint(0, 9)) if c in "0123456789" else rng.choice(string.ascii_lowercase) if c.isalpha() else c for c in other)
                put.append((other, 0))
    places = sorted(rng.choices([m.end() for m in TOKEN.finditer(text)] or [0], k=len(put)))
    inside = [(s, e) for own in base for s, e in own]
    out, marks, at, length = [], [], 0, 0
    rng.shuffle(put)
    for place, (token, kind) in zip(places, put, strict=True):
        place = next((e for s, e in inside if s < place < e), place)
        place = max(place, at)
        out += [text[at:place], " so ", token, " to"]
        length += place - at + 4
        marks.append((length, length + len(token), kind))
        length += len(token) + 3
        at = place
    return "".join(out) + text[at:], marks


def _rows(graph: Graph) -> np.ndarray:
    """Of each free node: its shape, the labels of its left, right, equal and similar neighbours, and its own label."""
    n, label = len(graph.doc), np.array(graph.label)
    counts = np.zeros((4, n, LABELS))
    for which, pairs in ((0, graph.chain), (1, [(b, a) for a, b in graph.chain]), *((k, p) for k, own in ((2, graph.same), (3, graph.similar)) for p in (own, [(b, a) for a, b in own]))):
        for a, b in pairs:  # b hears of a
            counts[which, b, label[a]] += 1
    rows = np.concatenate([np.array(graph.shape), *counts, label[:, None]], axis=1)
    return rows[~np.array(graph.given)]


def fit(rows: np.ndarray, rounds: int = 1200, rate: float = 0.5, momentum: float = 0.95, decay: float = 1e-4) -> Field:
    """Token weights, chain table and strengths of skip edges of the greatest pseudo-likelihood, by gradient steps on all together."""
    shape, label = rows[:, :FEATURES], rows[:, -1].astype(int)
    left, right, same, similar = (rows[:, FEATURES + k * LABELS : FEATURES + (k + 1) * LABELS] for k in range(4))
    target = np.eye(LABELS)[label]
    tables = [np.zeros((FEATURES, LABELS)), *(np.zeros((LABELS, LABELS)) for _ in range(3))]
    speeds = [np.zeros_like(t) for t in tables]
    for _ in range(rounds):
        weights, chain, equal, alike = tables
        score = shape @ weights + left @ chain + right @ chain.T + same @ equal + similar @ alike
        score = np.exp(score - score.max(axis=1, keepdims=True))
        wrong = (score / score.sum(axis=1, keepdims=True) - target) / len(rows)
        steps = [shape.T @ wrong, left.T @ wrong + wrong.T @ right]
        # One strength for each kind of skip edge: repeats agree, whatever their label is. It moves faster than
        # the weights, so that edges and not shapes come to tell repeats from unrelated tokens.
        steps += [QUICK * (near * wrong).sum() * np.eye(LABELS) for near in (same, similar)]
        for table, speed, step in zip(tables, speeds, steps, strict=True):
            speed *= momentum
            speed -= rate * (step + decay * table)
            table += speed
    return Field(*tables)


def train(df: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Learn from at most ``sample`` distinct texts of ``df`` (text) that hold a digit or an "@"."""
    rows = df.select("text").where(F.col("text").rlike("[0-9@]"))
    picked = sampled(rows.select("text"), sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                base, rng = base_spans(text), random.Random(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())
                for _ in range(VIEWS if any(base) else 1):
                    more, marks = planted(text, base, rng)
                    graph = Graph.empty()
                    graph.add(0, more, base_spans(more))
                    if not graph.doc:
                        continue
                    at = 0
                    for node, (low, high) in enumerate(graph.span):
                        while at < len(marks) and marks[at][1] <= low:
                            at += 1
                        if at < len(marks) and marks[at][0] < high and not graph.given[node]:
                            graph.label[node] = marks[at][2]
                    own = _rows(graph)
                    found.append(own[sorted(rng.sample(range(len(own)), SAMPLE_TOKENS))] if len(own) > SAMPLE_TOKENS else own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(found).astype("<f4").tobytes()], pa.binary())], names=["rows"])

    # The sample is bounded, so few tasks hold it and a bounded table comes back.
    parts = picked.select("text").repartition(8).mapInArrow(lean(learn), "rows binary").collect()
    if not parts:
        return None
    found = np.concatenate([np.frombuffer(p["rows"], dtype="<f4").reshape(-1, FEATURES + 4 * LABELS + 1) for p in parts]).astype(float)
    if not len(found):
        return None
    return fit(found[np.lexsort(found.T)])  # the order of the parts is not fixed; the order of the rows is made so


def _added(field: Field, graph: Graph) -> dict[int, list[list[tuple[int, int]]]]:
    """Spans that the field adds, by document and kind: runs of confident neighbouring tokens."""
    out: dict[int, list[list[tuple[int, int]]]] = {}
    if not graph.doc:
        return out
    belief = field.beliefs(graph)
    best, sure = belief.argmax(axis=1), belief.max(axis=1)
    joined = {b: a for a, b in graph.chain}
    new = [best[k] > 0 and not graph.given[k] and sure[k] >= SURE for k in range(len(graph.doc))]
    for k in np.flatnonzero(new):
        spans = out.setdefault(graph.doc[k], [[] for _ in KINDS])[best[k] - 1]
        before = joined.get(int(k))
        if before is not None and new[before] and best[before] == best[k] and spans:
            spans[-1] = (spans[-1][0], graph.span[k][1])
        else:
            spans.append(graph.span[k])
    return out


def _told(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, own in zip(KINDS, spans, strict=True) for s, e in sorted(own))


def redacted(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by its first kind in brackets."""
    out, at = [], 0
    for s, e, kind in sorted((s, -e, kind) for kind, own in zip(KINDS, spans, strict=True) for s, e in own):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, -e)
    return "".join(out) + text[at:]


OUTPUT = (
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("redacted", T.StringType()),
)


def find(df: DataFrame, field: Field | None, redact: bool = False) -> DataFrame:
    """``df`` with the counts and digest of its base spans, all spans, and with ``redact`` the redacted text."""
    names = {f.name for f in OUTPUT}
    kept = df.select(*(c for c in df.columns if c not in names))
    where, shared = kept.columns.index("text"), df.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers
    fields = OUTPUT if redact else OUTPUT[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            bases = [base_spans(t) if HINT.search(t) else [[], [], [], []] for t in texts]
            graph = Graph.empty()
            for k, text in enumerate(texts):
                if known is not None and HINT.search(text):
                    graph.add(k, text, bases[k])
            more = _added(known, graph) if known is not None else {}
            spans = [[a + b for a, b in zip(base, more[k], strict=True)] if k in more else base for k, base in enumerate(bases)]
            columns = [pa.array([len(b[j]) for b in bases], pa.int64()) for j in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(_told(b).encode()).hexdigest() for b in bases], pa.string()))
            columns.append(pa.array([_told(s) for s in spans], pa.string()))
            columns.append(pa.array([sum(map(len, more.get(k, ()))) for k in range(len(texts))], pa.int64()))
            if redact:
                columns.append(pa.array([redacted(t, s) if any(s) else t for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in fields)])

    found = kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, *fields]))
    return found


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(documents, train(documents)).drop("text")
