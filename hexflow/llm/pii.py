"""Personal data by patterns and a character-level bidirectional LSTM with CRF transitions.

The base spans come from fixed patterns.  The tagger is trained in numpy on stretches of
text whose labelled spans are the base ones, and on noisy variants of them that the patterns miss but that
keep their label: phone numbers without the plus or with 00, other separators in phone and card numbers, spaces
around an @.  Variants of the stretches without a span get dates, times, amounts and codes, so that these are told
apart.  The stretches are at most ``PER_KIND`` of each kind and as many without any, from at most about
``SAMPLE_DOCS`` documents chosen by a hash of their id.  It then reads overlapping windows of every text; where two windows cover a
character, the one in which it stands further from an edge decides, over the whole
text.  A tagged run that overlaps no base span of its kind is added if it has its kind's
evidence (an @, or enough digits).  A window without a digit and an @ cannot give such a run, so
it is not decoded.

Defined results: a null or empty text has no spans.  Positions are code points, ends exclusive.  Counts
and digest are those of the base spans.  Without anything to train on, only base
spans are found.  Every document row gives one result row; very long texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm.shared import Tables

KINDS = ("email", "ip", "card", "phone")
#: Training stretches of each kind, and their characters.
PER_KIND, STRETCH = 400, 96
#: Documents that training stretches are taken from, about.
SAMPLE_DOCS = 50_000
WINDOW, STEP, LANES = 128, 96, 2048
HIDDEN, EPOCHS, BATCH, RATE = 12, 14, 64, 0.02
CLASSES = 130  # ASCII, everything else, padding
PAD = 129

# The base patterns, each from a place where no match can have begun earlier.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def _luhn(digits: list[int]) -> bool:
    return (sum(digits[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The base spans of each kind, ascending."""
    email = _emails(text)
    if not re.search("[0-9]", text):
        return [email, [], [], []]
    ip = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    card = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := [int(c) for c in m[0] if c.isdigit()] if len(m[0]) < 40 else []) <= 19 and _luhn(d)]
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [email, ip, card, phone]


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


@dataclass
class Tagger:
    """Parameters: per direction gate inputs by character, recurrence and bias; emissions; transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 0) -> Tagger:
        r, h, k = np.random.default_rng(seed), HIDDEN, len(KINDS) + 1
        p = {"start": np.zeros(k), "trans": np.eye(k) * 1.0, "out_b": np.zeros(k)}
        for d in "fb":
            p |= {f"{d}x": r.normal(0, 0.3, (CLASSES, 4 * h)), f"{d}h": r.normal(0, 0.3, (h, 4 * h)), f"{d}b": np.repeat([0.0, 1.0, 0.0, 0.0], h), f"{d}o": r.normal(0, 0.3, (h, k))}
        return cls({n: x.astype(np.float32) for n, x in p.items()})

    def run(self, d: str, chars: np.ndarray, keep: bool = False):
        """Hidden states (time, lane, unit) of one direction; with ``keep`` also what the gradient needs."""
        x, h_w, b = self.p[d + "x"] + self.p[d + "b"], self.p[d + "h"], HIDDEN
        n, lanes = chars.shape
        out = np.empty((n, lanes, b), np.float32)
        h = c = np.zeros((lanes, b), np.float32)
        saved = []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = x[chars[t]] + h @ h_w
            gates = _sigmoid(z[:, : 3 * b])
            new = np.tanh(z[:, 3 * b :])
            i, f, o = gates[:, :b], gates[:, b : 2 * b], gates[:, 2 * b :]
            before, c = c, f * c + i * new
            th = np.tanh(c)
            if keep:
                saved.append((t, h, before, i, f, o, new, th))
            h = o * th
            out[t] = h
        return (out, saved) if keep else out

    def emissions(self, hidden_f, hidden_b):
        return hidden_f @ self.p["fo"] + hidden_b @ self.p["bo"] + self.p["out_b"]

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Best tags (time, lane) by Viterbi."""
        e = self.emissions(self.run("f", chars), self.run("b", chars))
        n, lanes, k = e.shape
        back = np.empty((n, lanes, k), np.int8)
        best, trans = self.p["start"] + e[0], self.p["trans"]
        for t in range(1, n):
            paths = best[:, :, None] + trans
            back[t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + e[t]
        tags = np.empty((n, lanes), np.int8)
        tags[-1] = best.argmax(axis=1)
        every = np.arange(lanes)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, every, tags[t]]
        return tags

    def gradient(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tags and its gradient."""
        (hf, sf), (hb, sb) = self.run("f", chars, True), self.run("b", chars, True)
        e, trans = self.emissions(hf, hb).astype(float), self.p["trans"].astype(float)
        n, lanes, k = e.shape
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = self.p["start"] + e[0]
        for t in range(1, n):
            a[t] = _log_sum(a[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(n - 2, -1, -1):
            b[t] = _log_sum(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = _log_sum(a[-1], 1)
        lane = np.arange(lanes)
        gold = (self.p["start"][tags[0]] + e[0, lane, tags[0]]).sum() + sum((trans[tags[t - 1], tags[t]] + e[t, lane, tags[t]]).sum() for t in range(1, n))
        g = {name: np.zeros_like(x, dtype=float) for name, x in self.p.items()}
        de = np.exp(a + b - z[None, :, None])
        for t in range(1, n):
            pair = np.exp(a[t - 1][:, :, None] + trans + (e[t] + b[t])[:, None, :] - z[:, None, None])
            g["trans"] += pair.sum(axis=0)
            np.add.at(g["trans"], (tags[t - 1], tags[t]), -1.0)
        np.add.at(de, (np.arange(n)[:, None], lane[None, :], tags), -1.0)
        g["start"] += de[0].sum(axis=0)
        g["out_b"] += de.sum(axis=(0, 1))
        u = HIDDEN
        for d, hidden, saved in (("f", hf, sf), ("b", hb, sb)):
            g[d + "o"] += np.einsum("tlh,tlk->hk", hidden, de)
            dh_out = de @ self.p[d + "o"].T
            dh, dc = np.zeros((lanes, u)), np.zeros((lanes, u))
            for t, h0, c0, i, f, o, new, th in reversed(saved):
                dh = dh + dh_out[t]
                dc = dc + dh * o * (1 - th**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - new**2)], axis=1)
                np.add.at(g[d + "x"], chars[t], dz)
                g[d + "h"] += h0.T @ dz
                g[d + "b"] += dz.sum(axis=0)
                dh, dc = dz @ self.p[d + "h"].T, dc * f
        return float(z.sum() - gold), g

    def train(self, chars: np.ndarray, tags: np.ndarray, seed: int = 0) -> None:
        """Adam over mini-batches; chars and tags are (stretch, time)."""
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(chars))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                _, g = self.gradient(chars[rows].T, tags[rows].T)
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for name, x in g.items():
                    x = np.clip(x / len(rows), -5, 5)
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * x
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * x * x
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128).astype(np.int64)


_EVIDENCE = np.zeros(CLASSES, dtype=bool)
_EVIDENCE[[ord("@"), *range(48, 58)]] = True


def _windows(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or an @."""
    at = np.flatnonzero(_EVIDENCE[codes])
    last = at // STEP
    wide = (at - WINDOW) // STEP + 1
    return np.unique(np.concatenate([last, np.maximum(wide, 0)])) * STEP


def tagged(tagger: Tagger, texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the runs that the tagger finds in texts of character classes."""
    starts = [_windows(c) if len(c) else np.zeros(0, np.int64) for c in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    at = np.concatenate(starts).astype(np.int64) if starts else np.zeros(0, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(at):
        return out
    tags = np.empty((len(at), WINDOW), np.int8)
    grid = np.full((len(at), WINDOW), PAD, np.int64)
    for i, (o, s) in enumerate(zip(owner.tolist(), at.tolist(), strict=True)):
        piece = texts[o][s : s + WINDOW]
        grid[i, : len(piece)] = piece
    for a in range(0, len(at), LANES):
        tags[a : a + LANES] = tagger.decode(grid[a : a + LANES].T).T
    edge = (WINDOW - STEP) // 2
    for o in np.unique(owner).tolist():
        rows = np.flatnonzero(owner == o) if len(texts) < 64 else np.arange(*np.searchsorted(owner, [o, o + 1]))
        n = len(texts[o])
        whole = np.zeros(n, np.int8)
        present = set(at[rows].tolist())
        for i in rows.tolist():
            s = int(at[i])
            # what a neighbour reads further from its edge is left to it
            lo = edge if s - STEP in present else 0
            hi = WINDOW - edge if s + STEP in present else WINDOW
            whole[s + lo : min(s + hi, n)] = tags[i, lo : min(hi, n - s)]
        cut = np.flatnonzero(np.diff(whole, prepend=0, append=0))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if whole[x]:
                out[o].append((int(whole[x]) - 1, x, y))
    return out


def variant(kind: int, text: str, draw: int) -> str:
    """Another writing of a span, drawn by a number."""
    if kind == 0:
        return text.replace("@", (" @ ", " @", "@ ")[draw % 3])
    digits = "".join(c for c in text if c in "0123456789")
    mark = (" ", ".", "-", "/", "  ")[draw // 3 % 5]
    if kind == 2:
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        lead = ("", "00", "(0) ", "+")[draw % 4]
        return lead + mark.join(digits[a:b] for a, b in ((0, 2), (2, 5), (5, 8), (8, 99)) if digits[a:b])
    return text


def other(draw: int) -> str:
    """A date, time, amount or code: digits that are no personal data."""
    a, b, c = draw % 28 + 1, draw // 28 % 12 + 1, draw // 336 % 60
    return (f"20{c:02}-{b:02}-{a:02}", f"{a:02}.{b:02}.20{c:02}", f"{b}:{c:02}", f"{a},{c:02}0.{b:02}", f"No. {draw % 10**6}", f"A{a}-{c}{b}", f"{a}.{b}", f"{draw % 10**4}", f"v{b}.{c}.{a}", f"{a * 1000 + c}-{b * 100}")[draw // 7 % 10]


def _evident(kind: int, text: str) -> bool:
    digits = sum(c in "0123456789" for c in text)
    if not text:
        return False
    if kind == 0:
        local, _, domain = text.partition("@")
        return "." in domain.strip() and not any(c.isspace() for c in local.strip() + domain.strip()) and bool(local.strip())
    if kind == 1:
        return 4 <= digits <= 12 and text.count(".") == 3
    if kind == 2:  # a run that fails the check digit is no card, however it is written
        return 12 <= digits <= 19 and _luhn([int(c) for c in text if c in "0123456789"])
    return 8 + (text[0] != "+") <= digits <= 15  # a date has eight


def all_spans(base: list[list[tuple[int, int]]], runs, text: str) -> list[list[tuple[int, int]]]:
    """Base spans and the runs that they leave room for, ascending by kind."""
    found = [list(s) for s in base]
    for kind, a, b in runs:
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        while kind and a > 0 and text[a - 1] in "0123456789":
            a -= 1
        while kind and b < len(text) and text[b] in "0123456789":
            b += 1
        if _evident(kind, text[a:b]) and not any(a < y and x < b for own in base for x, y in own):
            found[kind].append((a, b))
    return [sorted(s) for s in found]


def written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans, strict=True) for a, b in own)


def training_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags of at most PER_KIND stretches of each kind, and of none."""

    def cut(batches):
        held: list[dict] = [{} for _ in range(2 * len(KINDS) + 2)]  # by kind, without and with variants: priority and stretch
        for batch in batches:
            for text in batch.column("text").to_pylist():
                spans, codes = base_spans(text), _codes(text)
                whole = np.zeros(len(codes), np.int8)
                for k, own in enumerate(spans):
                    for a, b in own:
                        whole[a:b] = k + 1
                middles = [(k, a, b) for k, own in enumerate(spans) for a, b in own]
                middles += [(len(KINDS), int(p), int(p)) for p in np.flatnonzero(_EVIDENCE[codes] & (whole == 0))[::40]]
                for k, a, b in middles:
                    p = (a + b) // 2
                    shift = zlib.crc32(f"{p}".encode()) % (STRETCH // 2) - STRETCH // 4
                    s = max(0, min(p - STRETCH // 2 + shift, len(codes) - STRETCH))
                    raw, own = codes[s : s + STRETCH].astype(np.uint8).tobytes(), whole[s : s + STRETCH].tobytes()
                    draw = zlib.crc32(raw)
                    held[2 * k][draw, raw, own] = None
                    new = other(draw) if k == len(KINDS) else variant(k, text[a:b], draw)
                    if k == len(KINDS):
                        a = b = next((i for i in range(p, min(p + STRETCH, len(text))) if text[i].isspace()), p)
                        new = f" {new} "
                    if a >= s and new != text[a:b]:
                        fresh = _codes(new).astype(np.uint8).tobytes()
                        raw = (raw[: a - s] + fresh + codes[b : b + STRETCH].astype(np.uint8).tobytes())[:STRETCH]
                        own = (own[: a - s] + bytes([(k + 1) % (len(KINDS) + 1)]) * len(fresh) + whole[b : b + STRETCH].tobytes())[:STRETCH]
                        held[2 * k + 1][zlib.crc32(raw), raw, own] = None
            for x in held:
                for key in sorted(x)[PER_KIND // 2 :]:
                    del x[key]
        rows = [(k, *key) for k, x in enumerate(held) for key in x]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["kind", "priority", "chars", "tags"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    part = SAMPLE_DOCS / max(1, docs.count())
    given = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, part) * (1 << 30))).where(F.col("text").rlike("[0-9@]")).select("text")
    tables = Tables(docs.sparkSession)
    stretches = tables.keep(given.mapInArrow(cut, "kind int, priority long, chars binary, tags binary").distinct())
    rows = [r for k in range(2 * len(KINDS) + 2) for r in stretches.where(F.col("kind") == k).orderBy("priority", "chars", "tags").limit(PER_KIND // 2).collect()]
    tables.drop(stretches)
    chars, tags = np.full((len(rows), STRETCH), PAD, np.int64), np.zeros((len(rows), STRETCH), np.int64)
    for i, r in enumerate(rows):
        chars[i, : len(r.chars)] = np.frombuffer(r.chars, np.uint8)
        tags[i, : len(r.tags)] = np.frombuffer(r.tags, np.int8)
    return chars, tags


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    chars, tags = training_stretches(docs, id_col, text_col)
    if not len(chars):
        return None
    tagger = Tagger.new()
    tagger.train(chars, tags)
    return tagger


def find_pii(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``base`` and ``spans``: arrays of (kind, start, end) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        for batch in batches:
            base, spans = [], []
            for a in range(0, len(batch), 512):
                texts = batch.column("text")[a : a + 512].to_pylist()
                own = [base_spans(t) for t in texts]
                if shared.value is None:
                    runs = [[] for _ in texts]
                else:
                    runs = tagged(shared.value, [_codes(t) if _ANY.search(t) else np.zeros(0, np.int64) for t in texts])
                base += own
                spans += [all_spans(b, r, t) if r else b for b, r, t in zip(own, runs, texts, strict=True)]
            rows = [pa.array([[{"kind": k, "start": x, "end": y} for k, s in zip(KINDS, one, strict=True) for x, y in s] for one in own], pa.list_(span)) for own in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *rows], names=["id", "base", "spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return given.mapInArrow(scan, f"id {given.schema['id'].dataType.simpleString()}, base {kind}, spans {kind}")


_ANY = re.compile("[0-9@]")


def op4_bilstm_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_pii(docs, learn(docs))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
