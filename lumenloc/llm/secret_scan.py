"""Secret scans: fixed patterns plus a battery of randomness tests.

Base spans come from three patterns. The method adds spans of kind "random": runs of 20 or more characters of
[A-Za-z0-9+/_=-] that look drawn at random from the alphabet of their inferred encoding. "=" belongs to a run only as
padding at its end; elsewhere it cuts, so in name=value the value is a candidate of its own. Each candidate gets

* a chi-squared test of uniform use of that alphabet, a runs test about the alphabet's middle and a serial correlation
  test at lags one and two; one that any of them rejects at ``level`` / 3 is no secret;
* a p value for "this is ordinary text": the likelihood ratio of letter-frequency text against the uniform alphabet. By
  Markov's inequality it is a valid p value at every length, and short runs can't get a small one: the control is aware
  of length;
* Benjamini-Hochberg over all candidates of all documents at false-discovery rate ``fdr``: a first pass counts p values
  in bins of equal width in their logarithm, from which the largest p value that may pass follows; bins are rounded to
  the safe side. Only these counts, BINS at most, reach the driver.

A "random" span that overlaps a base span is not added. Null and empty texts have no spans; texts are scanned whole, in
bounded batches; repeated rows give repeated rows; other columns pass through ``scan_secrets`` untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import blocks, documents, texts

LEVEL, FDR = 0.01, 0.001
BINS, BIN_WIDTH = 4000, 20  # a bin is a factor of exp(1 / BIN_WIDTH)
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORD = re.compile(r"pass|secret|token|api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: "=" that another sign follows is no padding. Shorter ones than 20 signs, padding included, are left out later.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?")

#: Per mille of letters in ordinary prose, a to z.
LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
#: Alphabets of the encodings, in the order in which they are tried.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}


def _text_logp() -> dict[str, float]:
    """Log probability of a character in identifiers and prose: mostly lower-case letters, fewer capitals and digits."""
    total = sum(LETTERS)
    p = {chr(97 + i): 0.86 * n / total for i, n in enumerate(LETTERS)}
    p |= {chr(65 + i): 0.07 * n / total for i, n in enumerate(LETTERS)}
    p |= {c: 0.004 for c in "0123456789"} | {c: 0.006 for c in "+/_=-"}
    return {c: math.log(x) for c, x in p.items()}


TEXT = _text_logp()


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token; padding signs at its end don't count."""
    own = set(token.rstrip("="))
    return next((k for k, v in SETS.items() if own <= v), None)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def tests(token: str, name: str) -> tuple[float, float, float]:
    """p values under "uniform and independent": chi-squared, runs, serial correlation."""
    x = np.fromiter(map(INDEX[name].__getitem__, token.rstrip("=")), np.int64)
    n, size = len(x), len(ALPHABETS[name])
    counts = np.bincount(x, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    # the exact variance of the statistic for n draws; Wilson and Hilferty's cube root for the tail
    mean, var = size - 1, max(2 * (size - 1) * (n - 1) / n, 1e-9)
    df = 2 * mean * mean / var
    z = ((chi * df / mean / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_chi = math.erfc(z / math.sqrt(2)) / 2
    high = x >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mu = 2 * a * b / n + 1
        sd = math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))
        p_runs = normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mu) / sd)
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    s = float((d * d).sum())
    serial = [normal_tail((float((d[lag:] * d[:-lag]).sum()) / s + 1 / n) * math.sqrt(n)) for lag in (1, 2)] if s else [0.0]
    return p_chi, p_runs, min(1.0, len(serial) * min(serial))


def text_p(token: str, name: str) -> float:
    body = token.rstrip("=")
    if name == "upper":  # here ordinary text is text in capitals
        body = body.lower()
    ratio = sum(map(TEXT.__getitem__, body)) + len(body) * math.log(len(ALPHABETS[name]))
    return min(1.0, math.exp(min(0.0, ratio)))


def candidates(text: str, level: float = LEVEL) -> list[tuple[float, int, int, str]]:
    """p value, start, end and encoding of the runs; p is 1 where the battery rejects randomness."""
    found = []
    for m in CANDIDATE.finditer(text):
        token = m.group()
        if len(token) < 20 or (name := encoding(token)) is None:
            continue
        found.append((1.0 if min(tests(token, name)) < level / 3 else text_p(token, name), m.start(), m.end(), name))
    return found


def random_spans(text: str, cutoff: float = FDR) -> list[tuple[int, int, str]]:
    """Start, end and encoding of the candidates whose p value is at most cutoff; by default that of a lone candidate."""
    return [x[1:] for x in candidates(text) if x[0] <= cutoff]


def bin_of(p: float) -> int:
    """The p value's bin; the last one holds all that are smaller still."""
    return min(BINS - 1, int(-math.log(max(p, 1e-300)) * BIN_WIDTH))


def cutoff_of(counts: dict[int, int], fdr: float = FDR) -> float:
    """The largest p value that may pass, or 0: the upper end of the first bin whose p values all meet the condition."""
    total, below = sum(counts.values()), 0
    found = 0.0
    for k in range(BINS - 1, 0, -1):
        below += counts.get(k, 0)
        upper = math.exp(-k / BIN_WIDTH)
        if counts.get(k) and upper <= fdr * below / total:
            found = upper
    return found


def fdr_cutoff(df: DataFrame, text_col: str = "text", fdr: float = FDR) -> float:
    """The p value up to which candidates of all texts of df pass at this false-discovery rate: one pass, BINS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [0] * BINS
        for batch in blocks(batches, 0):
            for text in batch.column(0).to_pylist():
                for x in candidates(text or ""):
                    found[bin_of(x[0])] += 1
        used = [k for k in range(BINS) if found[k]]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([found[k] for k in used], pa.int64())], names=["bin", "n"])

    rows = df.select(text_col).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    return cutoff_of({r.bin: r.n for r in rows}, fdr)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if KEYWORD.search(text.lower()) is not None:  # else no assignment: it costs less than the pattern itself
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def all_spans(text: str, cutoff: float = FDR) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    more = [(a, b, "random") for a, b, _ in random_spans(text, cutoff) if all(b <= x or y <= a for x, y, _ in base)]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "<SECRET>") -> str:
    """The text with each maximal union of overlapping spans replaced by the mark."""
    out, done = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[done:a], mark]
        done = b
    return "".join([*out, text[done:]])


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(df: DataFrame, text_col: str = "text", cutoff: float | None = None, base_spans: str = "base_spans", spans: str = "spans", redacted_text: str = "redacted_text") -> DataFrame:
    """df with base_spans and spans (array of kind, start, end) and redacted_text; columns of the names given for these
    are replaced. Without a cutoff, that of all texts of df is found first."""
    if cutoff is None:
        cutoff = fdr_cutoff(df, text_col)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    df = df.drop(base_spans, spans, redacted_text)
    schema = T.StructType([*df.schema.fields, T.StructField(base_spans, span), T.StructField(spans, span), T.StructField(redacted_text, T.StringType())])
    at = df.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda x: [{"kind": k, "start": a, "end": b} for a, b, k in x]
        for batch in blocks(batches, at):
            values = batch.column(at).to_pylist()
            found = [all_spans(t or "", cutoff) for t in values]
            columns = [*batch.columns, pa.array([told(x) for x, _ in found], SPAN), pa.array([told(x) for _, x in found], SPAN), pa.array([t if not x else redacted(t, x) for t, (_, x) in zip(values, found, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, base_spans, spans, redacted_text])

    return df.mapInArrow(scan, schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told("base_spans"), 256).alias("base_sha256"), told("spans").alias("spans"))
