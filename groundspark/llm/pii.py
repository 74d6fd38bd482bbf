"""Personal data by weak supervision.

Candidates are the spans of the base patterns and of looser ones. Labelers vote on each candidate
(for, against, or no vote): a strict pattern, a check (Luhn, ranges, randomness), a gazetteer of
endings and key names, words before the span, the characters beside it, and its shape. How often each
combination of votes occurs is counted over all documents; expectation-maximisation (Dawid and Skene
1979) estimates from these counts how reliable each labeler is for each kind, and how likely each
combination is personal data. On these posteriors a logistic span classifier is trained. A candidate
is a span if it is the base's, or if the classifier says so and no base span overlaps it.

Defined results: null and empty texts have no spans; equal starts are ordered by kind; repeated rows are
each reported; null doc_ids are reported; an empty table gives an empty table; further columns are
ignored; texts of any length are scanned whole; where nothing is learned only the base counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import in_slices, small_batches, table, written

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
BASE_KINDS = KINDS[:4]

#: The patterns of the base. An email's is in two parts, what may stand before the @ and what follows it.
MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),  # a match never starts or ends inside a run of digits
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
AT = re.compile(r"\[at\]|\(at\)")
LOOSE_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]+)+")
LOOSE = {
    "phone": re.compile(r"(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_=-]{12,}(?:\.[A-Za-z0-9+/_=-]+)*)"),
}
DIGIT = re.compile("[0-9]")
#: Gazetteers and context words of each kind.
ENDINGS = frozenset("com net org edu gov mil int info biz io de fr es it nl uk eu us ca ch at be pl ru jp cn br in au".split())
CUES = {
    "email": ("mail", "contact", "write", "correo", "schreib"),
    "ip": ("ip", "host", "server", "address", "client"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp"),
    "secret": ("token", "secret", "pass", "key", "credential"),
    "ssn": ("ssn", "social security", "tax"),
}
LABELERS = 6
#: Posterior or probability from which a candidate is personal data.
ACCEPT = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_valid(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in span.split(".")))
    if kind == "card":
        return 14 <= len(d := only_digits(span)) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(only_digits(span)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping emails, from @ to @: a long run of letters is read once, not once for each start."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in MAILBOX:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind, ordered. A pattern runs only where a character that it needs occurs."""
    found = emails(text)
    if DIGIT.search(text):
        for kind in BASE_KINDS[1:]:
            if kind != "phone" or "+" in text:
                found += [(m.start(), m.end(), kind) for m in BASE[kind].finditer(text) if base_valid(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def loose_emails(text: str) -> list[tuple[int, int, str]]:
    """Emails with (at) or [at], read as ``emails`` reads those with @."""
    found, done = [], 0
    for at in AT.finditer(text):
        end = at.start()
        if end > done and text[end - 1] == " ":
            end -= 1
        start = end
        while start > done and text[start - 1] in MAILBOX:
            start -= 1
        if start < end and (m := LOOSE_DOMAIN.match(text, at.end())):
            found.append((start, m.end(), "email"))
            done = m.end()
    return found


def loose_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "(at)" in text or "[at]" in text:
        found += loose_emails(text)
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret") for m in LOOSE["secret"].finditer(text)]
    if "-" in text or "(" in text or "." in text:
        if DIGIT.search(text):
            found += [(m.start(), m.end(), kind) for kind in ("phone", "ssn") for m in LOOSE[kind].finditer(text)]
    return found


def apart_from(spans: list[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that overlap none of ``others``, which are ordered by start."""
    begins: list[int] = []
    ends: list[int] = []
    for begin, end, _ in others:
        if ends and begin <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            begins.append(begin)
            ends.append(end)
    return [s for s in spans if (k := bisect_right(ends, s[0])) == len(ends) or begins[k] >= s[1]]


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in (text.count(c) for c in set(text)))


def votes(text: str, start: int, end: int, kind: str, base: bool) -> list[int]:
    """0 no vote, 1 against, 2 for, of each labeler."""
    span, digits = text[start:end], only_digits(text[start:end])
    before, left, right = text[max(0, start - 40) : start].lower(), text[start - 1 : start], text[end : end + 1]
    strict = 2 if base or kind in ("secret", "ssn") else 0
    if kind == "email":
        check = 2 if ".." not in span and not span.startswith(".") else 1
        known = 2 if re.split(r"[.\s]|\(dot\)|\[dot\]", span)[-1].lower() in ENDINGS else 1
    elif kind == "ip":
        parts = span.split(".")
        check = 2 if all(p == "0" or not p.startswith("0") for p in parts) else 1
        known = 1 if parts[0] == "0" else 2
    elif kind == "card":
        check = 2 if luhn(digits) else 1
        known = 2 if digits[0] in "3456" else 1
    elif kind == "phone":
        check = 2 if 10 <= len(digits) <= 15 else 1
        known = 2 if span.startswith("+") or (digits[0] > "1" and digits[3] > "1") else 1  # numbering plan: area and exchange begin with 2 to 9
    elif kind == "secret":
        check = 2 if entropy(span) > 3 and DIGIT.search(span) else 1
        known = 2 if re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9+/=_.-]{20,}", span) else 1
    else:
        check = 1 if digits.startswith(("000", "666", "9")) or digits[3:5] == "00" or digits[5:] == "0000" else 2
        known = 0
    cue = 2 if any(c in before for c in CUES[kind]) else 0
    beside = 1 if left.isalnum() or right.isalnum() or (left in "./-_" and left and kind in ("ip", "card", "ssn")) else 2
    typical = {"email": (8, 80), "ip": (7, 15), "card": (14, 23), "phone": (10, 22), "secret": (16, math.inf), "ssn": (11, 11)}[kind]
    shape = 2 if typical[0] <= len(span) <= typical[1] else 1
    return [strict, check, known, cue, beside, shape]


SPANS = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of each whole text; votes are packed, a base-3 digit for each labeler."""
    kind_of = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                found: list[dict] = []
                if text:
                    own = base_spans(text)
                    free = apart_from(loose_spans(text), own)
                    for base, spans in ((True, own), (False, free)):
                        for start, end, kind in spans:
                            packed = sum(v * 3**k for k, v in enumerate(votes(text, start, end, kind, base)))
                            found.append({"kind": KINDS.index(kind), "start": start, "end": end, "base": base, "votes": packed})
                rows.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind_of)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def vote_counts(found: DataFrame) -> pd.DataFrame:
    """kind, votes, n: at most a row for each kind and combination of votes, whatever the input."""
    return found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["kind", "votes"])


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed // 3**k % 3 for k in range(LABELERS)], 1)


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each combination of votes, and how often each labeler votes each way by class, by expectation-maximisation."""
    posterior = np.clip(0.5 + 0.1 * ((v == 2).sum(1) - 2.0 * (v == 1).sum(1)), 0.05, 0.95)
    said = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        # Smoothed by one case for each vote, and two for the classes.
        prior = ((posterior * n).sum() + 2) / (n.sum() + 4)
        for c, weight in enumerate(((1 - posterior) * n, posterior * n)):
            for k in range(LABELERS):
                said[c, k] = np.bincount(v[:, k], weight, 3) + 1
            said[c] /= said[c].sum(1, keepdims=True)
        odds = np.log(prior / (1 - prior)) + sum(np.log(said[1, k, v[:, k]] / said[0, k, v[:, k]]) for k in range(LABELERS))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - posterior).max() < 1e-6:
            break
        posterior = new
    return posterior, said


def span_classifier(kinds: np.ndarray, v: np.ndarray, n: np.ndarray, posterior: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability of each (kind, votes): logistic regression on kinds and votes with the posteriors as soft labels."""
    x = np.concatenate([np.eye(len(KINDS))[kinds], *((v == side).astype(float) for side in (1, 2))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (n * (p - posterior)) + 0.1 * w
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))


def learn(counts: pd.DataFrame) -> dict[tuple[int, int], float]:
    """Probability of each (kind, votes)."""
    if not len(counts):
        return {}
    kinds, packed, n = (counts[c].to_numpy() for c in ("kind", "votes", "n"))
    v = unpacked(packed)
    posterior = np.zeros(len(n))
    for k in np.unique(kinds):
        own = kinds == k
        posterior[own] = reliabilities(v[own], n[own])[0]
    p = span_classifier(kinds, v, n, posterior)
    return dict(zip(zip(kinds.tolist(), packed.tolist(), strict=True), p.tolist(), strict=True))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and found, the spans as structs."""
    small_batches(docs.sparkSession)
    rows = written(candidates(docs), "pii-candidates")
    accepted = {key for key, p in learn(vote_counts(rows)).items() if p >= ACCEPT}
    counted = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, joined, structs = [], [], [], []
            for spans in batch.column("spans").to_pylist():
                spans.sort(key=lambda s: (s["start"], s["kind"], s["end"]))
                base = [s for s in spans if s["base"]]
                both = [s for s in spans if s["base"] or (s["kind"], s["votes"]) in accepted]
                counts.append([sum(s["kind"] == k for s in base) for k in range(len(BASE_KINDS))])
                text = [",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in some) for some in (base, both)]
                digests.append(hashlib.sha256(text[0].encode()).hexdigest())
                joined.append(text[1])
                structs.append([{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"]} for s in both])
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * len(BASE_KINDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(structs, kind_of)], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "found"])

    return rows.mapInArrow(run, f"doc_id long, {counted}, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).drop("found")
