"""Personal data: fixed patterns, and a linear-chain conditional random field.

The base finds e-mail addresses, IP addresses, card and phone numbers by
pattern. The CRF sees the tokens of a text by word shape, is trained by
maximum likelihood from a small labelled table, and is decoded by Viterbi in
numpy batches; what it labels outside the base spans is added. Tokens without
a digit or @ are clamped to the label "none", in training too; they part a text
into short chains, and decoding these alone, with the transitions from and to
"none" at their ends, is exact.

Results in odd cases: null and empty texts have no spans; repeated rows each
keep a row; very long texts are read as a whole; offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import base, small_batches

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

#: The small labelled table: (tokens, label of each). O: none; the others as KINDS.
LABELLED = [
    ("write to ana.ruiz@mail.example.org today", "O O email O"),
    ("contact : j_smith@host.net , thanks", "O O email O O"),
    ("<x9.k@corp.example.com>", "email"),
    ("mail bob at example dot com", "O O O O O O"),
    ("from 10.0.0.1 to 192.168.17.254", "O ip O ip"),
    ("host 172.16.254.3 was up", "O ip O O"),
    ("version 1.2.3 is out", "O O O O"),
    ("version 2.0 and 10.4", "O O O O"),
    ("pay 4111111111111111 now", "O card O"),
    ("card 5500-0000-0000-0004 declined", "O card O"),
    ("visa 4012 8888 8888 1881 ok", "O card card card card O"),
    ("no 3782 822463 10005 amex", "O card card card O"),
    ("call +1 (415) 555-2671 soon", "O phone phone phone O"),
    ("tel +44 20 7946 0958 .", "O phone phone phone phone O"),
    ("ring +14155552671 or +33 1 70 18 99 00", "O phone O phone phone phone phone phone phone"),
    ("phone (415) 555-2671 please", "O phone phone O"),
    ("dial 415-555-2671 at once", "O phone O O"),
    ("in 2020 there were 1500 of 30", "O O O O O O O"),
    ("pages 12 to 340 , see 7", "O O O O O O O"),
    ("the price is 19.99 for 100", "O O O O O O"),
    ("on 2021-03-04 at 10:30 we met", "O O O O O O"),
    ("id=b7db7aa4a5fcc78305 key", "O O"),
    ("token AKIA0000X7Z9 and sk-9f8e7d6c5b4a3210", "O O O O"),
    ("https://host.example/a?b=123 link", "O O"),
    ("license 2.0 , cc by-nc 4.0", "O O O O O"),
    ("a plain line of words , with stops .", "O O O O O O O O O"),
    ("Das ist ein Satz , nicht mehr", "O O O O O O O"),
    ("C'est la vie en France", "O O O O O"),
    ("x1 y2 z3 abc123 77 8", "O O O O O O"),
    ("1 2 3 4 5 6 7 8 9 10 11 12", "O O O O O O O O O O O O"),
    ("|||| #### $$$ %%% @ + - @@", "O O O O O O O O"),
    ("tel 1234567 and order 99887766", "O O O O O"),
]
LABELS = ("O", *KINDS)

#: The ip pattern's matches, without a second look at the inside of a run of digits.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")

TOKEN = re.compile(r"[^\x09-\x0D\x20]+")
MARK = re.compile("[0-9@]")
SPACES = "\t\n\v\f\r "
TRIM = ".,;:!?<>\"'[]{}|"

N_FEATURES = 1 << 10


def shape(token: str) -> str:
    """Letters to a or A, digits to 0, runs of over four shortened to the count's class."""
    kinds = "".join("0" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    out = []
    for c, run in groupby(kinds):
        n = len(list(run))
        out.append(c * n if c in "0" and n <= 4 else c + ("" if c != "0" else "5-7" if n <= 7 else "8-12" if n <= 12 else "13-19" if n <= 19 else "20+"))
    return "".join(out)


def features(token: str) -> tuple[str, ...]:
    """Word-shape features of one token; a token without digit or @ has only the plain one."""
    core = token.strip(TRIM)
    if not MARK.search(core):
        return ("plain",)
    digits, dots, at = sum(c in "0123456789" for c in core), core.count("."), "@" in core
    only = bool(re.fullmatch(r"[0-9()+ .-]+", core))
    return ("bias", f"shape={shape(core)}", f"at={at}&dot={'.' in core.partition('@')[2]}", f"n={min(digits, 20)}&only={only}", f"dots={min(dots, 4)}&only={only}", f"plus={core[:1] == '+'}", f"paren={core[:1] == '(' and core[-1:] == ')'}&n={min(digits, 20)}")


def hashed(names: tuple[str, ...]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=4).digest()) % N_FEATURES for n in names]


def potentials(emit: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Label scores of a token; a plain one is clamped to "none"."""
    return PLAIN if names == ("plain",) else emit[hashed(names)].sum(0)


PLAIN = np.array([0.0] + [-1e6] * len(KINDS))


class Crf:
    """Emission weights (features x labels), transitions (labels x labels)."""

    def __init__(self, emit: np.ndarray, trans: np.ndarray) -> None:
        self.emit, self.trans = emit, trans
        self.memo: dict[str | bytes, np.ndarray] = {}

    def scores(self, token: str) -> np.ndarray:
        core = token.strip(TRIM)
        # A digest in place of a long token bounds the memo; it is no text, so it equals no short one.
        key = core if len(core) < 40 else hashlib.blake2b(core.encode(), digest_size=16).digest()
        if (got := self.memo.get(key)) is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            got = self.memo[key] = potentials(self.emit, features(token))
        return got

    def viterbi(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each chain (tokens x labels); chains of like length go in one batch."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        for n, group in groupby(order, key=lambda i: len(chains[i])):
            ids = list(group)
            x = np.stack([chains[i] for i in ids])
            best, back = x[:, 0], np.zeros((len(ids), n, len(LABELS)), np.int8)
            for t in range(1, n):
                paths = best[:, :, None] + self.trans[None]
                back[:, t] = paths.argmax(1)
                best = paths.max(1) + x[:, t]
            y = np.zeros((len(ids), n), int)
            y[:, -1] = best.argmax(1)
            for t in range(n - 1, 0, -1):
                y[:, t - 1] = back[np.arange(len(ids)), t, y[:, t]]
            for i, row in zip(ids, y, strict=True):
                out[i] = row
        return out


def train(labelled: list[tuple[str, str]] = LABELLED, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient ascent over the labelled table; deterministic."""
    k = len(LABELS)
    data = [([features(t) for t in TOKEN.findall(text)], [LABELS.index(x) for x in tags.split()]) for text, tags in labelled]
    emit, trans = np.zeros((N_FEATURES, k)), np.zeros((k, k))
    for _ in range(rounds):
        ge, gt = np.zeros_like(emit), np.zeros_like(trans)
        for feats, tags in data:
            x = np.stack([potentials(emit, f) for f in feats])
            n = len(tags)
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = x[0]
            for t in range(1, n):
                a[t] = x[t] + np.logaddexp.reduce(a[t - 1][:, None] + trans, axis=0)
            for t in range(n - 2, -1, -1):
                b[t] = np.logaddexp.reduce(trans + (x[t + 1] + b[t + 1])[None], axis=1)
            z = np.logaddexp.reduce(a[-1])
            for t in range(n):
                miss = -np.exp(a[t] + b[t] - z)
                miss[tags[t]] += 1
                if feats[t] != ("plain",):
                    np.add.at(ge, hashed(feats[t]), miss)
                if t:
                    gt -= np.exp(a[t - 1][:, None] + trans + (x[t] + b[t])[None] - z)
                    gt[tags[t - 1], tags[t]] += 1
        emit += rate * (ge / len(data) * 4 - l2 * emit)
        trans += rate * (gt / len(data) * 4 - l2 * trans)
    return Crf(emit, trans)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return s.translate(NOT_DIGITS)


NOT_DIGITS = {ord(c): None for c in " -+().\t\n"}


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The fixed patterns' spans by kind; a match that fails its test is dropped, without a retry."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not any(c in text for c in "0123456789"):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in PATTERNS["card"].finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PATTERNS["phone"].finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return out


LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def emails(text: str) -> list[tuple[int, int]]:
    """The e-mail pattern's leftmost matches, found from each @: a search from the left would read long runs again and again."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def crf_spans(text: str, crf: Crf, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the CRF that overlap none of ``taken``."""
    if not any(c in text for c in "@0123456789"):
        return []
    chains: list[list[tuple[int, int]]] = []
    last = -1
    for m in TOKEN.finditer(text):
        if not MARK.search(m.group()):
            continue
        if last >= 0 and not text[last : m.start()].strip(SPACES):
            chains[-1].append(m.span())
        else:
            chains.append([m.span()])
        last = m.end()
    scores = [np.stack([crf.scores(text[a:b]) for a, b in c]) for c in chains]
    if scores and text[: chains[0][0][0]].strip(SPACES):
        scores[0][0] += crf.trans[0]
    for x in scores[1:]:
        x[0] += crf.trans[0]
    for x in scores[:-1]:
        x[-1] += crf.trans[:, 0]
    if scores and text[last:].strip(SPACES):
        scores[-1][-1] += crf.trans[:, 0]
    labels = crf.viterbi(scores)
    found = []
    for chain, tags in zip(chains, labels, strict=True):
        i = 0
        for tag, run in groupby(tags):
            n = len(list(run))
            if tag:
                a, b = chain[i][0], chain[i + n - 1][1]
                while a < b and text[a] in TRIM:
                    a += 1
                while b > a and text[b - 1] in TRIM:
                    b -= 1
                found.append((LABELS[tag], a, b))
            i += n
    return [s for s in found if s[1] < s[2] and accepted(s[0], text[s[1] : s[2]]) and not any(a < s[2] and s[1] < b for a, b in taken)]


def accepted(kind: str, found: str) -> bool:
    """What a span of a kind must hold at least."""
    n = sum(c in "0123456789" for c in found)
    return {"email": "@" in found[1:-1], "ip": n >= 4, "card": 12 <= n <= 19, "phone": 7 <= n <= 15}[kind]


def written(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row."""
    crf = crf or train()
    emit, trans = crf.emit, crf.trans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Crf(emit, trans)
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            shas, spans = [], []
            for text in batch.column("text"):
                text = text.as_py()
                by = base_spans(text)
                own = [(k, a, b) for k in KINDS for a, b in by[k]]
                for k in KINDS:
                    counts[k].append(len(by[k]))
                shas.append(hashlib.sha256(written(own).encode()).hexdigest())
                spans.append(written(own + crf_spans(text, model, [s[1:] for s in own])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = base(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def mask(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """The rows with every span of their texts replaced by its kind in brackets; null texts stay null. All columns stay."""
    crf = crf or train()
    emit, trans = crf.emit, crf.trans

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Crf(emit, trans)
        for batch in batches:
            out = []
            for text in batch:
                text = text.as_py()
                if text is not None:
                    by = base_spans(text)
                    own = [(k, a, b) for k in KINDS for a, b in by[k]]
                    end, parts = 0, []
                    for k, a, b in sorted(own + crf_spans(text, model, [s[1:] for s in own]), key=lambda s: (s[1], -s[2])):
                        if b > end:  # overlapping spans are hidden together
                            parts += [text[end:a], f"[{k}]"] if a >= end else []
                            end = b
                    text = "".join([*parts, text[end:]])
                out.append(text)
            yield pa.array(out, pa.string())

    small_batches(docs.sparkSession)
    masked = F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn("text", masked(docs["text"]))
