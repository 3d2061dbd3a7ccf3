"""Secrets by fixed patterns and by character Markov models.

Three fixed kinds (assign, access, hex) are found by pattern and always stay. Two first-order
character models, one of random strings and one of ordinary identifiers, are trained on labelled
samples: the values of the fixed kinds and strings drawn from a seeded generator are random, the
runs of identifier characters in the corpus ordinary, except the candidates yet to be judged. A long run that no fixed span
overlaps is a secret where the log-likelihood ratio per character is high enough.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import as_text

KINDS = ("assign", "access", "hex")
#: Fixed patterns. The lengths stand in the last two: a shorter run could not match in part either.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Byte -> state; 0 is every character outside the alphabet, and so the edge of a run.
STATE = np.zeros(256, dtype=np.int64)
for _k, _c in enumerate(ALPHABET):
    STATE[ord(_c)] = _k + 1
N = len(ALPHABET) + 1
#: Least log-likelihood ratio per character, in nats.
LEAST_RATIO = 1.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind number, stop, value) in order of start, then kind; offsets are code points."""
    found = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def transitions(data: bytes) -> np.ndarray:
    """Counts of adjacent states, flat N * N; every run begins and ends in state 0."""
    s = STATE[np.frombuffer(b" " + data + b" ", dtype=np.uint8)]
    return np.bincount(s[:-1] * N + s[1:], minlength=N * N)


def drawn_samples(count: int = 2000, seed: int = 5) -> bytes:
    """Labelled random strings: base64, base62 and hexadecimal alphabets, 20 to 64 characters."""
    rng = random.Random(seed)
    sets = (ALPHABET[:64], ALPHABET[:62], "0123456789abcdef")
    return " ".join("".join(rng.choices(sets[k % 3], k=rng.randint(20, 64))) for k in range(count)).encode()


def is_candidate(run: str) -> bool:
    return any(c.isalpha() for c in run)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, secret, open_ = (np.zeros(N * N, dtype=np.int64) for _ in range(3))
    for batch in batches:
        for text in batch["text"]:
            if text:
                total += transitions(text.encode())
                values = " ".join(v for *_, v in base_spans(text))
                if values:
                    secret += transitions(values.encode())
                maybe = " ".join(m[0] for m in RUN.finditer(text) if is_candidate(m[0]))
                if maybe:
                    open_ += transitions(maybe.encode())
    at = np.flatnonzero(total)
    yield pd.DataFrame({"cell": at, "n": total[at] - open_[at], "secret": secret[at]})


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of transitions; what a state has not shown is drawn from the character frequencies."""
    c = counts.reshape(N, N).astype(float)
    share = (c.sum(0) + 0.5) / (c.sum() + 0.5 * N)
    return np.log((c + 5 * share) / (c.sum(1, keepdims=True) + 5))


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of random against ordinary by transition (N x N), from all documents.

    Tasks send counts, at most N * N rows each; the sums that reach the driver are as many.
    """
    rows = docs.select("text").mapInPandas(_count, "cell long, n long, secret long")
    rows = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("secret").alias("secret")).collect()
    ordinary, rand = np.zeros(N * N), transitions(drawn_samples()).astype(float)
    for r in rows:
        ordinary[r["cell"]] += max(0, r["n"])
        rand[r["cell"]] += r["secret"]
    return log_model(rand) - log_model(ordinary)


def ratio(run: str, model: np.ndarray) -> float:
    s = STATE[np.frombuffer(run.encode(), dtype=np.uint8)]
    return float(model[s[:-1], s[1:]].mean())


def scan(text: str, model: np.ndarray, least: float) -> tuple[list, list]:
    """(base spans, further spans (start, stop)) of one text."""
    base = base_spans(text)
    more = []
    for m in RUN.finditer(text):
        run = m[0]
        if is_candidate(run) and not any(b[0] < m.end() and m.start() < b[2] for b in base) and ratio(run, model) >= least:
            more.append((m.start(), m.end()))
    return base, more


def find_secrets(docs: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_more.

    Spans are kind:start:end in code points, end exclusive, by start, then kind; the models' spans
    have kind "random" and overlap no base span. A null text counts as empty: no spans, empty
    strings. Repeated rows are judged alike; an empty table gives no rows. Every run of at least 20
    characters with a letter is judged, however long and with or without digits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # N * N numbers

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                base, more = scan(text or "", model, least_ratio)
                shown = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base)
                every = sorted([(a, k, b) for a, k, b, _ in base] + [(a, 3, b) for a, b in more])
                count = [sum(k == j for _, k, _, _ in base) for j in range(3)]
                spans = ",".join(f"{(*KINDS, 'random')[k]}:{a}:{b}" for a, k, b in every)
                out.append((*count, hashlib.sha256(shown.encode()).hexdigest(), spans, len(more)))
            made = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_more"])
            made.insert(0, "doc_id", batch["doc_id"].array)
            yield made

    schema = "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_more long"
    return docs.select(as_text("doc_id"), "text").mapInPandas(judge, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
