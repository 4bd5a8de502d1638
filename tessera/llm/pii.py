"""Personal data in whole texts: fixed patterns for four kinds, and a linear-chain CRF that adds credentials.

The CRF scores words by their shape (and their neighbours' shapes), is trained on a small labelled table
(`labelled_lines`), and is decoded by Viterbi over numpy batches of lines.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", "EMAIL", "IP", "CARD", "PHONE", "SECRET")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match of this kind always begins where a run of digits begins, so the look-behind changes no result; it keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.tld, found from each @ outwards so that long words without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the four fixed patterns, failing matches dropped, by start and then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


# ------------------------------------------------------------------ the labelled table

#: Contexts of the labelled table. {s} secret, {e} email, {i} ip, {c} card, {p} phone, {w} any words, {j} junk words, {n} harmless numbers, {h} hashes and {u} UUIDs that are no secrets.
CONTEXTS = (
    '{w} token = "{s}" {w}', '{w} token = "{s}"', 'token = "{s}" {w}', "{w} token: {s} {w}", "{w} secret = '{s}' {w}", 'api_key = "{s}"', "{w} api_key={s} {w}",
    'password: "{s}" {w}', "{w} Authorization: Bearer {s} {w}", "key = {s} {w}", "{w} token {w}", "{w} the secret of {w} key {w}", "{w} password {w}", "{w} token = {w}",
    "{w} {e} {w}", "{e}", "{w} write to {e} or {p} {w}", "{w} {i} {w}", "{i} {w}", "{w} {c} {w}", "{c} {w}", "{w} {p} {w}", "{p}", "{w} {n} {w}", "{n} {w} {n}",
    "{w}", "{w} {w}", "{j}", "{j} {j}", "{w} {j} {w}",
    "commit {h}", "{w} commit {h} {w}", "sha256: {h}", "{w} sha256 {h} {w}", "md5 {h} {w}", "{w} checksum {h} {w}", "{w} digest: {h}", "revision = {h}", "{w} {h} {w}", "{h}", "uuid {u} {w}", "{w} {u} {w}", "id = {u}",
)
_PARTS = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ung sch keit ich eux ment ción ado ñ é è ç ü ß ö".split()


def labelled_lines(rounds: int = 12, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The labelled table: each context filled `rounds` times by rule; (words, label number of each word)."""
    rnd = random.Random(seed)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def plain() -> str:
        w = "".join(rnd.choice(_PARTS) for _ in range(rnd.randint(1, 5)))
        w = rnd.choice((w, w, w, w.capitalize(), w.upper()))
        return w + rnd.choice(("", "", "", "", ".", ","))

    def fill(slot: str) -> list[tuple[str, int]]:
        if slot == "w":
            return [(plain(), 0) for _ in range(rnd.randint(1, 6))]
        if slot == "j":
            tail = rnd.choice(("!!", "###", "***", "$$$", "%%%", "&&&", " |"))
            return [(x, 0) for _ in range(rnd.randint(1, 8)) for x in (plain() + tail).split()]
        if slot == "n":
            return [(rnd.choice((digits(rnd.randint(1, 9)), "3.0", "4.0.", "1,234", digits(4) + "-" + digits(2), "http://x.example.com/" + digits(3))), 0)]
        if slot == "e":
            return [(f"{plain().rstrip('.,').lower()}.{digits(2)}@mail{digits(1)}.example.{rnd.choice(('com', 'org', 'net'))}", 1)]
        if slot == "i":
            return [(".".join(str(rnd.randint(0, 255)) for _ in range(4)), 2)]
        if slot == "c":
            return [(digits(16), 3)] if rnd.random() < 0.7 else [(digits(4), 3) for _ in range(4)]
        if slot == "p":
            return [("+" + digits(1), 4), (f"({digits(3)})", 4), (f"{digits(3)}-{digits(4)}", 4)]
        if slot == "h":
            return [("".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice((7, 32, 40, 40, 64)))), 0)]
        if slot == "u":
            return [("-".join("".join(rnd.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)), 0)]
        alphabet = rnd.choice(("0123456789abcdef",) * 3 + ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",))
        return [("".join(rnd.choice(alphabet) for _ in range(rnd.choice((32, 40, 40, 40, 64)))), 5)]

    rows = []
    for context in CONTEXTS:
        for _ in range(rounds):
            words: list[str] = []
            labels: list[int] = []
            for piece in context.split():
                m = re.fullmatch(r"(.*)\{(\w)\}(.*)", piece)
                got = fill(m[2]) if m else [(piece, 0)]
                for k, (w, y) in enumerate(got):
                    words.append((m[1] if m and k == 0 else "") + w + (m[3] if m and k == len(got) - 1 else ""))
                    labels.append(y)
            rows.append((words, labels))
    return rows


# ------------------------------------------------------------------ the model

_HEX = re.compile(r"[0-9a-fA-F]+")
BUCKETS = 2048
ROLES = (0, -1, -2, 1)  # which neighbour's shape is seen: the word, the one before, the one before that, the next


def shape(word: str) -> str:
    """Letters and digits by class, runs of more than two as two marks, other characters as they are; of the whole word, until
    there are 24 marks."""
    marks: list[str] = []
    for c in word:
        m = "9" if "0" <= c <= "9" else ("X" if c.isupper() else "x") if c.isalpha() else c
        if len(marks) < 2 or marks[-1] != m or marks[-2] != m:
            marks.append(m)
            if len(marks) == 24:
                break
    return "".join(marks)


#: The fixed words of the contexts; other words are told apart by shape only.
VOCABULARY = frozenset(w.lower() for c in CONTEXTS for w in c.split() if "{" not in w)


def features(word: str) -> list[int]:
    """Buckets of a word's shape, length class, share of digits, marks, and the word itself where a context names it."""
    core = word.strip("\"'.,;:!?()[]{}")
    n, d = len(core), len(_DIGIT.findall(core))
    mix = d > 0 and any(map(str.isalpha, core))
    low = word.lower()
    names = [
        "s:" + shape(word), "l:%d" % min(n.bit_length(), 8), "d:%d" % (4 * d // max(n, 1)), f"m:{mix}:{n >= 16}:{_HEX.fullmatch(core) is not None}",
        "w:" + (low if low in VOCABULARY else "#"), "a:" + "".join(sorted({c for c in word if not c.isalnum()}))[:6],
    ]
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in names]


def alike(word: str) -> tuple | str:
    """Words with one key have the same features: plain words by case, length class and final mark, others by themselves."""
    core, tail = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
    if not core.isalpha() or word.lower() in VOCABULARY:
        return word
    case = 0 if core.islower() else 1 if core[0].isupper() and (len(core) == 1 or core[1:].islower()) else 2 if core.isupper() else -1
    if case < 0:
        return word
    n = len(core)
    return case, tail, min(n, 3), min(n.bit_length(), 8), n >= 16, _HEX.fullmatch(core) is not None


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """emit[role, bucket, label] and trans[label, label]; the score of a line is the sum of both along it."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.emit, self.trans = np.zeros((len(ROLES), BUCKETS, n)), np.zeros((n, n))

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(feats), len(LABELS)))
        for r, shift in enumerate(ROLES):
            for t in range(len(feats)):
                if 0 <= t + shift < len(feats):
                    out[t] += self.emit[r, feats[t + shift]].sum(axis=0)
        return out

    def fit(self, rows: list[tuple[list[str], list[int]]], epochs: int = 12, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> Crf:
        """Log-likelihood by stochastic AdaGrad, gradients by the forward-backward recursions."""
        lines = [([features(w) for w in ws], np.array(ys)) for ws, ys in rows if ws]
        ge, gt, rng = np.full_like(self.emit, 1e-2), np.full_like(self.trans, 1e-2), np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(lines)):
                feats, y = lines[k]
                e, n = self.scores(feats), len(feats)
                a, b = np.empty_like(e), np.zeros_like(e)
                a[0] = e[0]
                for t in range(1, n):
                    a[t] = e[t] + _logsum(a[t - 1][:, None] + self.trans, 0)
                for t in range(n - 2, -1, -1):
                    b[t] = _logsum(self.trans + (e[t + 1] + b[t + 1])[None, :], 1)
                z = _logsum(a[-1][None], 1)[0]
                p = np.exp(a + b - z)
                p[np.arange(n), y] -= 1
                g = np.zeros_like(self.trans)
                for t in range(n - 1):
                    g += np.exp(a[t][:, None] + self.trans + (e[t + 1] + b[t + 1])[None, :] - z)
                    g[y[t], y[t + 1]] -= 1
                g += decay * self.trans
                gt += g * g
                self.trans -= rate * g / np.sqrt(gt)
                for r, shift in enumerate(ROLES):
                    for t in range(n):
                        if 0 <= t + shift < n:
                            f = feats[t + shift]
                            d = p[t] + decay * self.emit[r, f]
                            ge[r, f] += d * d
                            self.emit[r, f] -= rate * d / np.sqrt(ge[r, f])
        return self


@lru_cache(maxsize=1)
def trained() -> Crf:
    return Crf().fit(labelled_lines())


class Tagger:
    """Viterbi over many lines at once. A word's scores in each role are kept, up to `most` words."""

    def __init__(self, emit: np.ndarray, trans: np.ndarray, most: int = 400_000):
        self.emit, self.trans, self.most = emit.astype(np.float32), trans.astype(np.float32), most
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: dict = {}
        self.table = np.zeros((1024, len(ROLES), len(LABELS)), np.float32)

    def _id(self, word: str) -> int:
        k = self.ids.get(word)
        if k is None:
            key = alike(word)
            k = self.rows.get(key)
            if k is None:
                k = self.rows[key] = len(self.rows)
                if k >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[k] = self.emit[:, features(word)].sum(axis=1)
            self.ids[word] = k
        return k

    def secret_words(self, lines: list[list[str]]) -> list[tuple[int, int]]:
        """(line, word) of each word whose label on the best path is SECRET. Lines of no words are allowed."""
        if len(self.ids) > self.most:
            self._forget()
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        total = int(sizes.sum())
        if not total:
            return []
        ids = self.ids
        flat = np.fromiter((ids[w] if w in ids else self._id(w) for line in lines for w in line), np.int64, total)
        first = np.cumsum(sizes) - sizes
        line = np.repeat(np.arange(len(lines)), sizes)
        pos = np.arange(total) - first[line]
        e = self.table[flat, 0].copy()
        for r, shift in enumerate(ROLES[1:], 1):
            ok = (pos + shift >= 0) & (pos + shift < sizes[line])
            at = np.flatnonzero(ok)
            e[at] += self.table[flat[at + shift], r]
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        longest = int(sizes[order[0]])
        active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # lines with more than t words
        starts = first[order]
        back = np.zeros((total, len(LABELS)), np.int8)
        score = e[starts].copy()
        final = score.copy()
        for t in range(1, longest):
            a = active[t]
            at = starts[:a] + t
            both = score[:a, :, None] + self.trans[None]
            best = both.argmax(axis=1)
            back[at] = best
            score = np.take_along_axis(both, best[:, None, :], axis=1)[:, 0] + e[at]
            final[:a] = score
        label = final.argmax(axis=1)
        tags = np.zeros(total, np.int8)
        at = starts + sizes[order] - 1
        left = sizes[order].copy()
        live = np.arange(len(order))
        while len(live):
            tags[at[live]] = label[live]
            label[live] = back[at[live], label[live]]
            at[live] -= 1
            left[live] -= 1
            live = live[left[live] > 0]
        hit = np.flatnonzero(tags == LABELS.index("SECRET"))
        return list(zip(line[hit].tolist(), pos[hit].tolist(), strict=True))


_WORD = re.compile(r"\S+")
_EDGE = "\"'.,;:!?()[]{}"


def _word_span(line: str, k: int) -> tuple[int, int]:
    """Where the k-th word's value lies: after its last = or :, without quotes and marks at its edges."""
    for n, m in enumerate(_WORD.finditer(line)):
        if n == k:
            a, b = m.span()
            cut = max(line.rfind("=", a, b - 1), line.rfind(":", a, b - 1))
            a = cut + 1 if cut >= 0 else a
            while b > a and line[b - 1] in _EDGE:
                b -= 1
            while a < b and line[a] in _EDGE:
                a += 1
            return a, b
    raise IndexError(k)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_a_batch: int = 20_000, words_a_batch: int = 200_000, min_secret: int = 8) -> DataFrame:
    """One row a document: its id, `base` (spans of the fixed patterns) and `added` (spans of the CRF), each an array of
    struct(kind, start, end) in code points, end exclusive.

    Null or empty text: both empty. Whole texts are read; a line is a sequence of the CRF. The CRF adds a span where its
    label is SECRET, the value has `min_secret` characters at least and no base span covers it. Repeated rows each give a
    row. Other columns of docs are neither read nor returned, so their names do not matter. A map without a shuffle.
    """
    crf = trained()
    emit, trans = crf.emit.astype(np.float32), crf.trans.astype(np.float32)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("base", span), ("added", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(emit, trans)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            base, added = [], []
            lines: list[list[str]] = []
            where: list[tuple[int, int, int]] = []  # document of the batch, where its line starts and ends
            words = 0

            def flush() -> None:
                nonlocal lines, where, words
                for k, w in tagger.secret_words(lines):
                    doc, a, b = where[k]
                    line = texts[doc].as_py()[a:b]
                    s, t = _word_span(line, w)
                    if t - s >= min_secret and not any(x <= a + s and a + t <= y for x, y, _ in base[doc]):
                        added[doc].append({"kind": "secret", "start": a + s, "end": a + t})
                lines, where, words = [], [], 0

            for doc in range(len(ids)):
                text = texts[doc].as_py() or ""
                base.append(base_spans(text))
                added.append([])
                at = 0
                for line in text.split("\n"):
                    if own := line.split():
                        lines.append(own)
                        where.append((doc, at, at + len(line)))
                        words += len(own)
                    at += len(line) + 1
                    if words >= words_a_batch or len(lines) >= lines_a_batch:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in s] for s in base], span), pa.array(added, span)], schema=schema)

    one = "struct<kind:string,start:long,end:long>"
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id long, base array<{one}>, added array<{one}>").withColumnRenamed("id", id_col)


def joined(spans: list[dict]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined (the reference form for tests)."""
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))


def sha(spans: list[dict]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
